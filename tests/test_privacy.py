"""The audit's rules on cases of every kind; addresses against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from lodestrata.operators import privacy


def kinds(spark, text):
    return sorted((r.kind, r.informational) for r in privacy.findings(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect())


def wanted(raw):
    if raw == "::":
        return None
    try:
        a = ipaddress.ip_address(raw)
    except ValueError:
        return None
    for kind in ("loopback", "link_local", "private", "multicast"):
        if getattr(a, f"is_{kind}"):
            return f"{kind}_ip"
    return "reserved_ip" if a.is_reserved or a.is_unspecified else "public_ip"


def test_addresses_as_the_standard_library_has_them(spark):
    rng = random.Random(2)
    v4 = [".".join(str(rng.choice([0, 1, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 254, 255, 256, rng.randrange(300)])) for _ in range(4)) for _ in range(400)]
    v4 += ["172.16.0.1", "172.32.0.1", "192.0.0.9", "192.0.0.10", "192.0.0.8", "192.0.2.7", "198.18.1.1", "198.20.1.1", "198.51.100.3", "203.0.113.9", "01.2.3.4", "1.2.3.00"]
    v6 = [":".join(rng.choice(["", "0", "1", "fe80", "fc00", "ff02", "2001", "db8", "2600", "4000", "abcd", "100", "12345"]) for _ in range(rng.randint(3, 9))) for _ in range(600)]
    v6 += ["::", "::1", "1::", "fe80::1", "fd00::1", "2001:db8::1", "2001:3::1", "2001:20::1", "2001:4:112::1", "2001:1ff::", "2001:200::", "2002::1", "100::5", "100:0:0:1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", ":1:2:3:4:5:6:7"]
    for addresses, form, classify in ((v4, privacy.V4_FORM, privacy.v4_class), (v6, privacy.V6_FORM, privacy.v6_class)):
        df = spark.createDataFrame([(a,) for a in set(addresses)], "a string").where(F.col("a").rlike(form))
        rows = df.select("a", classify(F.col("a")).alias("kind")).collect()
        assert len(rows) > 100
        assert [(r.a, r.kind, wanted(r.a)) for r in rows if r.kind != wanted(r.a)] == []


def test_boundaries(spark):
    assert kinds(spark, "1.2.3.4.5 and .10.0.0.1 and 10.0.0.1.") == []
    assert kinds(spark, "(10.0.0.1)") == [("private_ip", False)]
    assert kinds(spark, "paper::10.1007/x A301::desc at 12:30:45") == []
    assert kinds(spark, "0a:1b:2c:3d:4e:5f,") == [("mac_address", False)]
    assert kinds(spark, "b0a:1b:2c:3d:4e:5f0") == []
    assert kinds(spark, "xlocalhost localhosts") == [] and kinds(spark, "LOCALHOST") == [("internal_hostname", False)]
    assert kinds(spark, None) == kinds(spark, "") == []


def test_urls_and_secrets(spark):
    assert kinds(spark, "https://a:b1@x.org/p).") == [("credential_bearing_url", False)]
    assert kinds(spark, "https://user1@x.org https://x.org/a@b https://x.org?q=a:b@c") == [("credential_bearing_url", False)]
    assert kinds(spark, "https://username:pw@x.org") == [("credential_placeholder_url", True)]
    assert kinds(spark, "https://x.org/k?x-amz-signature=ab") == [("aws_presigned_url", False)]
    assert kinds(spark, "https://x.org/k?X-Amz-Signature=%5BREDACTED%5D") == [("redacted_presigned_url", True)]
    assert kinds(spark, "secret: 'abcdefgh12'\nsecret: short\npassword=your_password") == [("assigned_secret", False), ("credential_placeholder", True)]
    assert kinds(spark, "AKIA" + "A1" * 8 + " ghp_" + "x" * 30 + " sk-" + "y" * 20) == [("aws_access_key", False), ("github_token", False), ("openai_key", False)]


def test_a_value_counts_once_a_line_and_is_never_shown(spark):
    text = "10.0.0.1 10.0.0.1\n10.0.0.1\r\n::1"
    rows = privacy.findings(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()
    assert sorted((r.line, r.kind, r.preview) for r in rows) == [(1, "private_ip", "10….1"), (2, "private_ip", "10….1"), (3, "loopback_ip", "[REDACTED]")]


def test_network_fields_at_any_depth(spark):
    text = '{"a": {"IP": "10.0.0.1", "b": [{"mac": "x"}]}, "dns": {}, "gateway": {"v": 1}, "ipv4": "8.8.8.8", "subnet": 24, "ip": "none", "host_name": ""}'
    rows = privacy.network_fields(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, j string"), "id", "j").collect()
    assert sorted((r.key, r.kind) for r in rows) == [
        ("IP", "private_ip_network_field"), ("gateway", "sensitive_network_field"), ("ipv4", "public_ip_network_field"), ("mac", "sensitive_network_field"), ("subnet", "sensitive_network_field"),
    ]

"""Secret and network audit, and redaction, by column expressions.

A text is read line by line, and a line meets a rule only if it holds what every match of the
rule must hold, which a plain substring test tells. Addresses are found as whole runs of the
signs that an address may have, so that a longer run is never taken for one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public forms of tokens, and the names and placeholders that the audit goes by.
TOKENS = {
    "aws_access_key": r"\b((?:AKIA|ASIA)[A-Z0-9]{16})\b",
    "github_token": r"\b(gh[pousr]_[A-Za-z0-9]{30,})\b",
    "openai_key": r"\b(sk-[A-Za-z0-9_-]{20,})\b",
    "jwt": r"\b(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})\b",
}
SECRET_NAMES = ["api[_-]?key", "access[_-]?token", "password", "passwd", "secret", "authorization", "bearer"]
PLACEHOLDER = "(?i)^(?:api_?)?(?:username|token|password|key|secret)|example|placeholder|redacted|your[_-]"
SIGNED = "X-Amz-(?:Credential|Signature|Security-Token)="
INTERNAL_HOSTS = ["localhost", "host.docker.internal"]
NETWORK_FIELDS = (
    "ip ip_address ipaddress ipv4 ipv6 mac mac_address macaddress gateway subnet netmask dns dns_server dnsserver hostname host_name "
    "server_address serveraddress ssh_host sshhost snmp_community snmpcommunity"
).split()
ALWAYS_SENSITIVE = "hostname host_name server_address ssh_host snmp_community mac mac_address gateway subnet netmask dns dns_server".split()
#: Public registries of address blocks that are not for the open net.
PRIVATE_V4 = "0.0.0.0/8 10.0.0.0/8 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4".split()
PUBLIC_V4 = "192.0.0.9/32 192.0.0.10/32".split()
PRIVATE_IPV4 = r"\b(?:10\.[0-9]{1,3}|127\.[0-9]{1,3}|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|169\.254)\.[0-9]{1,3}\.[0-9]{1,3}\b"

V4_FORM = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"
V6_FORM = r"^([0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _within(address: Column, blocks: list[str]) -> Column:
    bounds = []
    for block in blocks:
        start, _, bits = block.partition("/")
        low = reduce(lambda n, x: 256 * n + int(x), start.split("."), 0)
        bounds.append(address.between(low, low + (1 << 32 - int(bits)) - 1))
    return _any(bounds)


def v4_class(raw: Column) -> Column:
    """The kind of an address of four numbers; null if one is above 255 or has a leading zero."""
    parts = F.split(raw, r"\.")
    bad = F.exists(parts, lambda x: (x.cast("int") > 255) | ((F.length(x) > 1) & x.startswith("0")))
    a, b = parts[0].cast("int"), parts[1].cast("int")
    address = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x.cast("long"))
    return (
        F.when(bad, None).when(a == 127, "loopback_ip").when((a == 169) & (b == 254), "link_local_ip")
        .when(_within(address, PRIVATE_V4) & ~_within(address, PUBLIC_V4), "private_ip").when(a.between(224, 239), "multicast_ip").otherwise("public_ip")
    )


def v6_class(raw: Column) -> Column:
    """The kind of an address of hexadecimal groups; null for what is none, and for '::'."""
    sides = F.split(raw, "::", -1)
    groups = F.transform(sides, lambda s: F.filter(F.split(s, ":", -1), lambda g: (s != "") | (g != "")))
    left, right = F.get(groups, F.lit(0)), F.coalesce(F.get(groups, F.lit(1)), F.array().cast("array<string>"))
    missing = 8 - F.size(left) - F.size(right)
    fits = (F.size(sides) <= 2) & ~F.exists(F.concat(left, right), lambda g: g == "") & F.when(F.size(sides) == 1, missing == 0).otherwise(missing >= 1)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    n = F.transform(whole, lambda g: F.conv(g, 16, 10).cast("int"))
    g = lambda i: F.get(n, F.lit(i))
    rest = F.aggregate(F.slice(n, 1, 7), F.lit(0), lambda s, x: s + x)
    special = (g(0) == 0x2001) & (g(1) < 0x200) & ~((g(1) == 3) | g(1).between(0x20, 0x3F) | ((g(1) == 4) & (g(2) == 0x112)))
    private = (
        g(0).between(0xFC00, 0xFDFF) | special | ((g(0) == 0x2001) & (g(1) == 0xDB8)) | (g(0) == 0x2002) | ((g(0) == 0x100) & (g(1) == 0) & (g(2) == 0) & (g(3) == 0))
        | ((g(0) == 0x64) & (g(1) == 0xFF9B) & (g(2) == 1)) | ((g(0) == 0) & (g(1) == 0) & (g(2) == 0) & (g(3) == 0) & (g(4) == 0) & (g(5) == 0xFFFF))
    )
    kind = (
        F.when((rest == 0) & (g(7) == 1), "loopback_ip").when(g(0).between(0xFE80, 0xFEBF), "link_local_ip").when(private, "private_ip")
        .when(g(0) >= 0xFF00, "multicast_ip").when(~g(0).between(0x2000, 0x3FFF), "reserved_ip").otherwise("public_ip")
    )
    return F.when(fits & (raw != "::"), kind)


def _found(line: Column, needs: Column, values: Column, kind) -> Column:
    """Structs of kind, value and whether it only informs, of a line that holds what the rule needs."""
    return F.when(needs, F.transform(values, kind))


def _finding(kind: Column, raw: Column, informs: Column) -> Column:
    return F.struct(kind.alias("kind"), raw.alias("raw"), informs.alias("informational"))


def _address(classify):
    return lambda x: _finding(classify(x), x, classify(x) == "public_ip")


def _secret(kind: str):
    return lambda x: _finding(F.when(x.rlike(PLACEHOLDER), "credential_placeholder").otherwise(kind), x, x.rlike(PLACEHOLDER))


def _runs(line: Column, signs: str, form: str) -> Column:
    return F.filter(F.regexp_extract_all(line, F.lit(f"([{signs}]+)"), 1), lambda x: x.rlike(form))


def _login(url: Column) -> tuple[Column, Column]:
    """User and password in a URL, '' if it has none."""
    place = F.regexp_extract(url, r"(?i)^https?://([^/?#]*)@", 1)
    return F.substring_index(place, ":", 1), F.regexp_extract(place, "^[^:]*:(.*)$", 1)


def _logins(url: Column) -> Column:
    user, password = _login(url)
    open_ = (user != "") | (password != "")
    named = user.rlike(PLACEHOLDER) | password.rlike(PLACEHOLDER)
    return F.when(open_, _finding(F.when(named, "credential_placeholder_url").otherwise("credential_bearing_url"), url, named))


def _signatures(url: Column) -> Column:
    redacted = url.rlike(rf"(?i)[?&]{SIGNED}(?:%5B|\[)?REDACTED")
    return F.when(url.rlike(f"(?i)[?&]{SIGNED}"), _finding(F.when(redacted, "redacted_presigned_url").otherwise("aws_presigned_url"), url, redacted))


def _rules(line: Column) -> list[Column]:
    urls = F.transform(F.regexp_extract_all(line, F.lit("((?i)https?://[^\\s\"'<>]+)"), 1), lambda u: F.regexp_replace(u, r"[.,);\]]+$", ""))
    links = F.lower(line).contains("://")
    hosts = "|".join(h.replace(".", r"\.") for h in INTERNAL_HOSTS)
    names = "|".join(SECRET_NAMES)
    plain = lambda kind: lambda x: _finding(F.lit(kind), x, F.lit(False))
    return [
        _found(line, line.rlike("[0-9][.][0-9]"), _runs(line, "0-9.", V4_FORM), _address(v4_class)),
        _found(line, line.contains(":"), _runs(line, "A-Za-z0-9_:", V6_FORM), _address(v6_class)),
        _found(line, line.rlike("[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"), F.regexp_extract_all(line, F.lit("(?<![0-9A-Fa-f])((?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2})(?![0-9A-Fa-f])"), 1), plain("mac_address")),
        _found(line, F.lower(line).contains("host"), F.regexp_extract_all(line, F.lit(rf"(?i)\b({hosts})\b"), 1), plain("internal_hostname")),
        _found(line, links & line.contains("@"), urls, _logins),
        _found(line, F.lower(line).contains("x-amz-"), urls, _signatures),
        *[_found(line, _any([line.contains(part) for part in parts]), F.regexp_extract_all(line, F.lit(TOKENS[kind]), 1), _secret(kind)) for kind, parts in (("aws_access_key", ("AKIA", "ASIA")), ("github_token", ("gh",)), ("openai_key", ("sk-",)), ("jwt", ("eyJ",)))],
        _found(line, line.rlike("[:=]"), F.regexp_extract_all(line, F.lit(rf"(?i)\b(?:{names})\b\s*[:=]\s*[\"']?([A-Za-z0-9_./+=:-]{{8,}})"), 1), _secret("assigned_secret")),
    ]


def findings(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, line, kind, value_sha256, preview, informational), one row per distinct value of a kind in a line."""
    lines = docs.select(id_, F.posexplode_outer(F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]")).alias("line", "said"))
    # What no rule needs is left out before any rule is tried: every match holds one of these.
    held = lines.where(F.col("said").rlike(r"[0-9]\.[0-9]|[:=]|(?i:host)|A[KS]IA|gh[pousr]_|sk-|eyJ|[0-9A-Fa-f]-[0-9A-Fa-f]"))
    found = F.filter(F.flatten(F.array_compact(F.array(*_rules(F.col("said"))))), lambda x: x.isNotNull() & x["kind"].isNotNull())
    rows = held.select(id_, (F.col("line") + 1).alias("line"), F.explode(F.array_distinct(found)).alias("hit"))
    hidden = F.when(F.length("hit.raw") <= 6, "[REDACTED]").otherwise(F.concat(F.substring("hit.raw", 1, 2), F.lit("…"), F.right("hit.raw", F.lit(2))))
    return rows.select(id_, "line", "hit.kind", F.sha2("hit.raw", 256).alias("value_sha256"), hidden.alias("preview"), "hit.informational")


def network_fields(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, key, kind) of network settings in JSON text, at any depth: fields with a filled value that tells an address or always matter."""
    pair = r'"([A-Za-z0-9_]+)"\s*:\s*("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|[\[{](?=\s*[^\]}\s]))'
    keys, values = (F.regexp_extract_all(F.col(text), F.lit(pair), i) for i in (1, 2))
    pairs = docs.select(id_, F.explode(F.arrays_zip(keys.alias("key"), values.alias("value"))).alias("pair")).select(id_, "pair.key", F.regexp_replace("pair.value", '^"|"$', "").alias("value"))
    own = pairs.where(F.lower("key").isin(NETWORK_FIELDS) & (F.col("value") != ""))
    address = F.when(F.col("value").rlike(V4_FORM), v4_class(F.col("value"))).when(F.col("value").rlike(V6_FORM), v6_class(F.col("value")))
    always = F.when(F.lower("key").isin(ALWAYS_SENSITIVE), "sensitive_network_field")
    return own.select(id_, "key", F.coalesce(F.concat(address, F.lit("_network_field")), always).alias("kind")).where("kind IS NOT NULL")


def redact(text: Column) -> tuple[Column, Column]:
    """(text with private addresses, signed query values and internal hosts replaced, number of replacements)."""
    steps = [
        (PRIVATE_IPV4, "[REDACTED PRIVATE ADDRESS]"),
        (r"(?i)(X-Amz-(?:Credential|Signature|Security-Token)=)[^&\s]+", "$1[REDACTED]"),
        (r"(?i)https?://(?:localhost|host\.docker\.internal)[^\s]*", "[REDACTED INTERNAL URL]"),
        (r"(?i)\b(?:localhost|host\.docker\.internal)\b", "[REDACTED INTERNAL HOST]"),
    ]
    done = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)
    return done, reduce(lambda c, s: c + F.regexp_count(text, F.lit(s[0])), steps[:2] + steps[3:], F.lit(0))


def drop_keys(pairs: Column, banned: list[str]) -> Column:
    """A map without the keys whose letters and digits, lower-cased, are banned."""
    return F.map_filter(pairs, lambda k, v: ~F.regexp_replace(F.lower(k), "[^a-z0-9]", "").isin(banned))

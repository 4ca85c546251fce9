"""Input checks, builds that resume, and the rules of links and questions."""

import hashlib

import pytest

from pyspark.sql import functions as F

from lodestrata.functions import questions as qs
from lodestrata.operators import linking
from lodestrata.plans import QUERIES
from lodestrata.sources import builds


def test_files_are_checked_against_their_catalog(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    rows = b'{"a": 1}\n\n{"a": 2}\n'
    for name in ("good.jsonl", "short.jsonl", "sub/changed.jsonl"):
        (tmp_path / name).write_bytes(rows)
    (tmp_path / "text.txt").write_bytes(b"x")
    sha = hashlib.sha256(rows).hexdigest()
    catalog = [
        ("good.jsonl", len(rows), sha, 2), ("short.jsonl", len(rows), sha, 3), ("sub/changed.jsonl", len(rows), "0" * 64, None),
        ("text.txt", 1, hashlib.sha256(b"x").hexdigest(), 1), ("gone.jsonl", 1, sha, None), ("text.txt ", 2, sha, None),
    ]
    df = spark.createDataFrame(catalog, "path string, byte_size long, sha256 string, records long")
    found = {r.path: r.problem for r in builds.verify_files(spark, str(tmp_path), df).collect()}
    assert found == {"good.jsonl": None, "short.jsonl": "record count", "sub/changed.jsonl": "sha-256", "text.txt": "records of a file without lines", "gone.jsonl": "missing", "text.txt ": "missing"}


def test_a_build_resumes_and_rejects_changed_inputs(spark, tmp_path):
    path = str(tmp_path / "build")
    rows = spark.createDataFrame([(i, f"t{i}" if i else None) for i in range(6)], "id long, text string")
    needed = {"model": "m1"}
    assert builds.resume(rows, path, needed, "id", "text").count() == 6
    builds.add_batch(rows.where("id < 4"), path)
    left = builds.resume(rows.orderBy(F.desc("id")), path, needed, "id", "text")
    assert sorted(r.id for r in left.collect()) == [4, 5]
    with pytest.raises(ValueError, match="model changed"):
        builds.resume(rows, path, {"model": "m2"}, "id", "text")
    with pytest.raises(ValueError, match="rows changed"):
        builds.resume(rows.withColumn("text", F.lit("other")), path, needed, "id", "text")
    with pytest.raises(ValueError, match="record_count changed"):
        builds.resume(rows.where("id > 0"), path, needed, "id", "text")


@pytest.mark.parametrize(
    "question, day",
    [
        ("how many on 2024-03-05?", "2024-03-05"), ("on March 5, 2023", "2023-03-05"), ("the 5th of march 2023", "2023-03-05"), ("2023 mar 5", "2023-03-05"),
        ("5/3", "2024-05-03"), ("dec 31", "2023-12-31"), ("feb 30 2024", None), ("2024-13-01", None), ("yesterday", None), ("", None),
    ],
)
def test_named_days(spark, question, day):
    assert spark.createDataFrame([(question,)], "q string").select(qs.named_day(F.col("q"), "2024-06-15")).first()[0] == day


@pytest.mark.parametrize(
    "question, floor",
    [("above magnitude 2", (2.0, False)), ("M2+ quakes", (2.0, True)), ("magnitude 2.5 or larger", (2.5, True)), ("at least M 3", (3.0, True)), (">= -0.5", (-0.5, True)), ("how many", None)],
)
def test_magnitude_floors(spark, question, floor):
    got = spark.createDataFrame([(question,)], "q string").select(qs.magnitude_floor(F.col("q"))).first()[0]
    assert (tuple(got) if got else None) == floor


def test_forms_of_a_day(spark):
    cases = [
        ("2026-10-01", "2026-10-01"), ("on 2023-10-01t", None), ("11-Nov-2023", "2023-11-11"), ("nov-11-2023", "2023-11-11"), ("2023-Nov-11", "2023-11-11"), ("Oct. 1sr, 2022", "2022-10-01"),
        ("1 October", "2023-10-01"), ("the 3rd of March", "2024-03-03"), ("10/1/2021", "2021-10-01"), ("2/30/2021", None), ("february 30", None), ("5 decades", "2023-12-05"),
        ("x10/1", None), ("1/2/20233", "2024-01-02"), ("", None), (None, None), ("june 15", "2024-06-15"), ("june 16", "2023-06-16"), ("marching 5", None), ("29 feb", "2024-02-29"),
    ]
    rows = spark.createDataFrame(cases, "q string, day string").select("q", "day", qs.named_day(F.col("q"), "2024-06-15").alias("got")).collect()
    assert [(r.q, r.got) for r in rows if r.got != r.day] == []


def test_how_far_locations_reach(spark):
    page = "Catalog last updated at 22-Oct-2026 22:32:06 UTC with locations up to  08-Oct-2026 11:00:00 UTC"
    rows = spark.createDataFrame([(page,), ("no such line",), (None,), ("locations up to 99-Oct-2026 11:00:00 UTC",)], "p string")
    assert [str(r[0]) for r in rows.select(qs.located_until(F.col("p"))).collect()] == ["2026-10-08 11:00:00", "None", "None", "None"]


def test_links_without_any_filled_column(spark):
    hits = spark.createDataFrame([(1, "s", 7, None, None, None, None, None)], "paper int, sensor string, hit int, kind string, layer string, use boolean, share int, stations int")
    papers = spark.createDataFrame([], "paper int, year int, overview boolean, on_topic boolean")
    assert linking.judge_links(hits, papers).count() == 0
    named = hits.withColumn("kind", F.lit("named"))
    assert [tuple(r) for r in linking.judge_links(named, papers).collect()] == [(1, "s", "used", 1, 0, 7)]


def test_sites_of_sensors_apart_say_nothing(spark):
    used = spark.createDataFrame([(1, "AX01a"), (1, "AX01b"), (2, "AX01a"), (2, "MG02a"), (3, None)], "paper int, place string")
    named = spark.createDataFrame([(2, "margin")], "paper int, site string")
    got = linking.study_sites(used, named, [("vents", "AX01")], [("vents", "volcano")])
    assert sorted(map(tuple, got.collect())) == [(1, "vents", "sensors"), (1, "volcano", "sensors"), (2, "margin", "named")]


def test_anti_join_reads_every_order(spark, tmp_path):
    spark.range(4).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, 5.0), (2, 500000.0)], "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.c_custkey for r in QUERIES["join_anti"](spark, str(tmp_path)).collect()} == {1, 3}


@pytest.mark.parametrize("rows", [[], [None, None], ["b", None, "a", "b"], [f"{i * 7919 % 1000}" for i in range(25_000)], ["a", "c", *["b"] * 25_000]])
def test_digest_in_order_is_that_of_the_sorted_list(spark, rows):
    known = sorted(r for r in rows if r is not None)
    wanted = hashlib.sha256(",".join(known).encode()).hexdigest() if rows else None
    found = builds.digest_in_order(spark.createDataFrame([(r,) for r in rows], "h string").repartition(3), "h").collect()
    assert [tuple(r) for r in found] == [(wanted, len(rows))]


def test_fingerprint_takes_in_the_last_digits(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("|"), "text"), 256).alias("h"))
    wanted = hashlib.sha256(",".join(sorted(r.h for r in d.collect())).encode()).hexdigest()
    assert QUERIES["build_fingerprint"](spark, sf_dir).first().fingerprint == wanted

"""Step-dependent operators on small inputs, against rules worked out by hand or by a plain second form."""

from pyspark.sql import functions as F

from lodestrata.operators import chunking, intervals, sites
from lodestrata.plans import QUERIES, SQL


def cut(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return [r.c for r in df.select("id", chunking.sentence_chunks(F.coalesce(words, F.array().cast("array<string>"))).alias("c")).orderBy("id").collect()]


def test_sentence_chunks(spark):
    words = [f"w{i}" for i in range(1000)]
    early = [*words[:299], "end.", *words[300:]]
    late = [*words[:379], "end.", *words[380:]]
    none, short, whole, a, b = cut(spark, [None, "a b", " ".join(words[:650]), " ".join(early), " ".join(late)])
    assert none == [] and short == ["a b"] and whole == [" ".join(words[:650])]
    # A stop at word 300 is too far back, one at word 380 is among the last 80.
    assert [len(c.split()) for c in a] == [450, 450, 220]
    assert b[0].endswith("end.") and b[1].startswith("w320 ") and b[-1].endswith("w999")


def test_heading_chunks(spark):
    text = "intro words\n\n# One\n\n" + "a " * 400 + "\n\n" + "b " * 300 + "\n\n# Two\n\n## Three\n\nc c c\n\n" + "d " * 90
    df = spark.createDataFrame([(1, text, "Title"), (2, "", "T"), (3, None, "T")], "id long, text string, title string")
    got = chunking.heading_chunks(df, "id", "text", "title").orderBy("id", "chunk").collect()
    # Units: Title 2 words, One 520 and 230 (50 shared), Three 93; each carries two words of heading.
    assert [(r.chunk, r.headings, r.words) for r in got] == [(0, ["Title", "One"], 526), (1, ["One", "Three"], 327)]
    assert got[0].body.startswith("## Title\n\nintro words\n\n## One\n\na a") and all(r.id == 1 for r in got)


def sensors(spark, rows):
    return {r.id: r.site for r in sites.cluster_sites(spark.createDataFrame(rows, "id long, lat double, lon double, code string")).collect()}


def test_sites_merge_through_a_bridge(spark):
    east, north = 0.125 / sites.KM_PER_LON, 0.05 / sites.KM_PER_LAT
    rows = [(1, 45.9, -130.0, "A"), (2, 45.9, -130.0 + 2 * east, "A"), (3, 45.9 + north, -130.0 + east, "A"), (4, 45.9, -129.99, "A"), (5, 46.5, -130.0, None)]
    assert sensors(spark, rows) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_sites_keep_codes_apart(spark):
    """A sensor without a code joins the nearest of two sites and does not bridge them."""
    rows = [(1, 45.9257, -129.9780, "INT1"), (2, 45.9258, -129.9778, "INT2"), (3, 45.92572, -129.978031, None)]
    assert sensors(spark, rows) == {1: 1, 2: 2, 3: 1}
    assert sensors(spark, rows[:0]) == {}


def test_two_witnesses(spark):
    rows = [("ok", "no_data", 0.0, True), ("ok", "no_data", 0.0, False), ("ok", "gaps", 0.5, True), ("no_data", "ok", 1.0, True), ("gaps", "no_data", 0.0, False), (None, "gaps", 0.5, True), ("ok", None, None, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c double, p boolean")
    state, agree = intervals.two_witnesses(F.col("a"), F.col("b"), F.col("c"), F.col("p"))
    got = [(r.s, r.g) for r in df.select("i", state.alias("s"), agree.alias("g")).orderBy("i").collect()]
    assert got == [("gaps", False), ("ok", True), ("gaps", False), ("ok", False), ("gaps", True), ("gaps", None), ("gaps", False)]


def test_rows_only_queries_run(spark, sf_dir):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_sensors_of_one_place_are_stood_for(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    places = [(45.0 + 0.0006 * int(a), -130.0 + 0.0009 * int(b)) for a, b in rng.integers(0, 8, (14, 2))]
    rows = [(i, *places[int(rng.integers(14))], [None, None, "a", "b", "c"][int(rng.integers(5))]) for i in range(400)]
    wanted = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    first = sites.ordered_groups(np.array([r[2] * sites.KM_PER_LON for r in wanted]), np.array([r[1] * sites.KM_PER_LAT for r in wanted]), [r[3] for r in wanted], sites.RADIUS_KM)
    named = {}
    for r, f in zip(wanted, first, strict=True):
        named[f] = min(named.get(f, r[0]), r[0])
    df = spark.createDataFrame([*rows, (900, None, None, "a"), (901, None, None, "a")], "id long, lat double, lon double, code string")
    found = {r.id: r.site for r in sites.cluster_sites(df).collect()}
    assert found == {r[0]: named[f] for r, f in zip(wanted, first, strict=True)} | {900: 900, 901: 901}
    assert sites.standing(df).where("id = stands AND lat IS NOT NULL").count() <= 14 * 7

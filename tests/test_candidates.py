"""Codes, ranges, designators, names and nearness, case by case."""

from lodestrata.operators import candidates

KEEP = ["paper", "passage"]


def rows(spark, *texts):
    return spark.createDataFrame([(f"p{i}", "fulltext", i, t) for i, t in enumerate(texts)], "paper string, layer string, passage long, text string")


def test_codes_and_ranges(spark):
    df = rows(spark, "HYS11-14, xHYS2 HYS20", "AXEC1 to AXEC3 and HYS9–11", "HYS1-HYS9 HYS5-3 HYS3-AXEC5", None, "")
    found = candidates.code_hits(df, KEEP, "(?:HYS|AXEC)[0-9]{1,2}", ["HYS", "AXEC"]).collect()
    assert sorted((r.passage, r.kind, r.code, r.start) for r in found) == sorted(
        [(0, "named", "HYS11", 0), (0, "named", "HYS20", 16)] + [(0, "range", f"HYS{n}", 0) for n in (11, 12, 13, 14)]
        + [(1, "named", "AXEC1", 0), (1, "named", "AXEC3", 9), (1, "named", "HYS9", 19)] + [(1, "range", f"AXEC{n}", 0) for n in (1, 2, 3)] + [(1, "range", f"HYS{n}", 19) for n in (9, 10, 11)]
        + [(2, "named", "HYS1", 0), (2, "named", "HYS9", 5), (2, "named", "HYS5", 10), (2, "named", "HYS3", 17), (2, "named", "AXEC5", 22)]
    )


def test_names_are_whole_words(spark):
    df = rows(spark, "Slope Base, Slope\n Base; Slope Bases. ASHES", "xASHES ASHES2 (ASHES)")
    names = spark.createDataFrame([("base", "Slope Base"), ("ashes", "ASHES"), ("void", "--")], "name string, phrase string")
    found = candidates.name_hits(df, names, KEEP).collect()
    assert sorted((r.passage, r.name, r.start, r.end) for r in found) == [(0, "ashes", 38, 43), (0, "base", 0, 10), (0, "base", 12, 23), (1, "ashes", 15, 20)]


def links(spark, texts, year=2015):
    passages = rows(spark, *texts)
    papers = spark.createDataFrame([(f"p{i}", year) for i in range(len(texts))], "paper string, year int")
    codes = spark.createDataFrame([("HYS14", "s1")], "code string, sensor string")
    keys = spark.createDataFrame([("RS01SLBS-LJ01A-12-CTDPFB101", "s2")], "designator string, sensor string")
    names = spark.createDataFrame(
        [("signal", "signal", "cabled array", None), ("context", "axial", "Axial", None), ("site", "base", "Slope Base", None), ("site", "caldera", "Central Caldera", "axial"), ("kind", "ctd", "CTD", None),
         ("system", "sonar", "COVIS", "axial"), ("system", "tilt", "BOTPT", None), ("feature", "ridge", "Hydrate Ridge", None)], "group string, name string, phrase string, needs string")
    sensors = spark.createDataFrame([("s2", "base", "ctd"), ("s3", "base", "ctd"), ("s4", "caldera", "tilt"), ("s5", "base", "tilt"), ("s6", None, None)], "sensor string, site string, kind string")
    systems = spark.createDataFrame([("sonar", "s6", False), ("tilt", "s4", True), ("tilt", "s5", True)], "system string, sensor string, signalled boolean")
    found = candidates.candidate_links(passages, papers, codes, keys, names, sensors, systems, "HYS[0-9]{1,2}", ["HYS"]).collect()
    return sorted((r.passage, r.target, r.kind, r.share, r.stations) for r in found)


def test_links_by_code_designator_and_feature(spark):
    assert links(spark, ["at HYS14 and HYS12-15 on Hydrate Ridge", "RS01SLBSLJ01A-CTDPFB101 seen", "RS01SLBS-XX99Z-03-CTDPFB101"]) == [
        (0, "ridge", "feature", None, 2), (0, "s1", "named", None, 2), (1, "s2", "designator", None, 0), (2, "s2", "designator", None, 0),
    ]


def test_descriptions_need_nearness_a_signal_and_a_year(spark):
    near, far = "cabled array. Slope Base has a CTD", "cabled array. Slope Base" + " x" * 160 + " CTD"
    assert links(spark, [near, far, "Slope Base has a CTD"]) == [(0, "s2", "described", 2, 0), (0, "s3", "described", 2, 0)]
    assert links(spark, [near], year=2008) == []


def test_systems(spark):
    assert links(spark, ["COVIS at Axial", "COVIS here"]) == [(0, "s6", "system", None, 0)]
    assert links(spark, ["cabled array BOTPT near Slope Base", "cabled array BOTPT", "BOTPT near Slope Base", "cabled array BOTPT" + " x" * 310 + " Slope Base"]) == [
        (0, "s5", "system", None, 0), (1, "s4", "described", 2, 0), (1, "s5", "described", 2, 0), (3, "s4", "described", 2, 0), (3, "s5", "described", 2, 0),
    ]


def test_names_of_a_long_passage_are_found_in_one_pass(spark, monkeypatch):
    df = spark.createDataFrame([("p", 1, "erth of a stone, " * 5000), ("p", 2, "of"), ("q", 3, None)], "paper string, passage long, text string")
    names = spark.createDataFrame([("one", "erth"), ("two", "of-a"), ("none", "a of")], "name string, phrase string")
    wanted = sorted([("one", 17 * i, 17 * i + 4) for i in range(5000)] + [("two", 17 * i + 5, 17 * i + 9) for i in range(5000)])
    for most in (candidates.BROADCAST_ROWS, 0):
        monkeypatch.setattr(candidates, "BROADCAST_ROWS", most)
        found = candidates.name_hits(df, names, KEEP)
        assert sorted((r.name, r.start, r.end) for r in found.collect()) == wanted
        # No list of a passage's pieces goes with each hit.
        assert "pieces" not in found._jdf.queryExecution().executedPlan().toString()

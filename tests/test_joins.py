"""Joins over places and titles where many rows share one; numbers beside codes."""

import math

import pytest

from pyspark.sql import functions as F

from lodestrata.functions import facts
from lodestrata.operators import joins


def km(a, b):
    (lat1, lon1), (lat2, lon2) = a, b
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


PLACES = [(10.0, 179.9), (10.0, -179.9), (10.5, 179.5), (-3.0, 20.0), (-3.2, 20.1), (60.0, 0.0)]


def points(spark, name, n):
    rows = [(i, *PLACES[i % len(PLACES)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} long, lat double, lon double"), {i: (lat, lon) for i, lat, lon in rows}


def test_places_are_compared_once_however_many_points_stand_there(spark):
    left, at = points(spark, "lid", 60)
    right, there = points(spark, "rid", 36)
    places = joins.near_places(left.select(F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), right.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), 120.0)
    assert places.count() == sum(km(a, b) <= 120 for a in PLACES for b in PLACES)
    found = joins.within_radius(left, right, 120.0).collect()
    wanted = {(i, j): km(a, b) for i, a in at.items() for j, b in there.items() if km(a, b) <= 120}
    assert len(found) == len(wanted) and {(r.lid, r.rid): r.km for r in found} == pytest.approx(wanted)
    nearest = {r.lid: r.rid for r in joins.nearest_within(left, right, 120.0).collect()}
    assert nearest == {i: min((km(a, b), j) for j, b in there.items())[1] for i, a in at.items()}


def distance(s, t):
    row = list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        before, row = row, [i]
        for j, b in enumerate(t, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return row[-1]


def test_similar_titles_pair_all_their_ids(spark):
    titles = ["large ring small", "large rung small", "large ring", "hot bolt", "hot bolts", None, "x"]
    rows = [(i, i % 2, titles[i % len(titles)]) for i in range(42)]
    found = joins.similar_titles(spark.createDataFrame(rows, "id long, k long, title string"), "id", ["k"], "title", 0.6).collect()
    ratio = lambda s, t: 1 - distance(s, t) / max(len(s), len(t))
    wanted = {(i, j): ratio(s, t) for i, k, s in rows for j, m, t in rows if i < j and k == m and s and t and ratio(s, t) >= 0.6}
    assert len(found) == len(wanted) and {(r.a, r.b): r.ratio for r in found} == pytest.approx(wanted)


@pytest.mark.parametrize(("text", "stated"), [("A-61000", False), ("5 Mar. 1995 XA-61000", False), ("A-61000-B", False), ("at 61,000.0 m by A-7", True), ("near 61000, unit a-5.", True), ("about -61000", True)])
def test_digits_of_a_code_are_no_number(spark, text, stated):
    row = spark.range(1).select(facts.states_number(F.lit(text), F.lit(61000.0), F.lit(10.0)).alias("ok")).first()
    assert row.ok is stated

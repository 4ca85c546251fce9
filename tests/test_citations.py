"""Matching in parallel against the plain sequence."""

import random
import re
import unicodedata

from lodestrata.operators import citations
from lodestrata.plans import QUERIES
from lodestrata.plans import citations as plan

TITLES = ["A long enough title about the shape of sea floors", "Another long enough title on tides and their records", "Short title"]


def plain(t):
    t = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]", "", t)


def plain_doi(t):
    return re.sub(r"(?i)^https?://(?:dx\.)?doi.org/", "", t.strip()).rstrip(".,;").lower()


def sequence(occurrences, works, number):
    by_doi, by_text = {}, {}
    titles = []
    for work, citation, dois, title in sorted(works):
        by_text[plain(citation)] = work
        by_doi.update({plain_doi(d): work for d in dois or []})
        titles.append((plain(title), work))
    out = []
    for occurrence, citation, dois in sorted(occurrences):
        text = plain(citation)
        dois = [plain_doi(d) for d in dois or [] if d and plain_doi(d)]
        found, method = {by_doi[d] for d in dois if d in by_doi}, "doi"
        if not found and text in by_text:
            found, method = {by_text[text]}, "exact_citation"
        if not found:
            found, method = {w for t, w in titles if len(t) >= 35 and t in text}, "title"
        if len(found) != 1:
            found, method = {f"NEW-{number}"}, "new_work"
            number += 1
            by_text[text] = next(iter(found))
            by_doi.update(dict.fromkeys(dois, next(iter(found))))
        out.append((occurrence, next(iter(found)), method))
    return out


def run(spark, occurrences, works, number=7):
    o = spark.createDataFrame(occurrences, "occurrence long, citation string, dois array<string>")
    w = spark.createDataFrame(works, "work string, citation string, dois array<string>, title string")
    return sorted(tuple(r) for r in citations.match_citations(o, w, number).collect())


def test_order_matters(spark):
    works = [("W1", "Old citation", ["10.1/a"], TITLES[0]), ("W2", "Old citation", ["https://doi.org/10.1/B."], TITLES[1])]
    occurrences = [
        (1, "x", ["10.1/A", "10.1/b"]), (2, "y", ["10.1/a"]), (3, "old, citation", None), (4, f"see {TITLES[0]} (2001)", []), (5, f"{TITLES[0]}; {TITLES[1]}", []), (6, f"{TITLES[0]}; {TITLES[1]}", []),
        (7, "z", ["10.1/c"]), (8, "other", ["10.1/c"]), (9, "z", []), (10, "", []), (11, None, None), (12, "other", []), (13, "x", []), (14, "q", ["10.1/c", "10.1/d"]), (15, "r", ["10.1/d"]),
    ]
    assert run(spark, occurrences, works) == sequence(occurrences, works, 7)
    assert run(spark, [], works) == [] and run(spark, occurrences, []) == sequence(occurrences, [], 7)


def test_random_chains_equal_the_sequence(spark):
    rng = random.Random(8)
    for keys in (12, 60):
        works = [(f"W{i}", f"citation {rng.randrange(keys)}", [f"10.1/{rng.randrange(keys)}" for _ in range(rng.randrange(3))], rng.choice(TITLES)) for i in range(6)]
        occurrences = []
        for i in range(250):
            text = f"citation {rng.randrange(keys)}" if rng.random() < 0.8 else f"{rng.randrange(9)} {rng.choice(TITLES)}"
            occurrences.append((i, text, [f"10.1/{rng.randrange(keys)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]))
        assert run(spark, occurrences, works) == sequence(occurrences, works, 7)


def test_query_equals_the_sequence(spark, sf_dir):
    occurrences, works = plan.tables(spark, sf_dir)
    wanted = sequence([tuple(r) for r in occurrences.collect()], [tuple(r) for r in works.collect()], 134)
    assert sorted(tuple(r) for r in QUERIES["citation_matching"](spark, sf_dir).collect()) == wanted
    assert {m for _, _, m in wanted} == {"doi", "exact_citation", "title", "new_work"}


def test_only_what_may_make_a_work_is_replayed(spark, monkeypatch):
    """Once an identifier or a text surely stands, citations with it alone are looked up, however many texts go with it."""
    occurrences = [(i, f"text {i}", ["10.1/hot"]) for i in range(300)] + [(300 + i, "text x", [f"10.2/{i}"]) for i in range(300)] + [(600, "y", ["10.1/hot", "10.2/0"]), (601, "text 7", ["10.1/hot"])]
    replayed = []
    kept = citations.materialize
    monkeypatch.setattr(citations, "materialize", lambda df, label: replayed.append(kept(df, label)) or replayed[-1] if label == "acting" else kept(df, label))
    assert run(spark, occurrences, []) == sequence(occurrences, [], 7)
    assert replayed[0].count() == 3

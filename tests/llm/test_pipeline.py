"""The pipeline's stages against brute force on a fixture, on awkward tables and on the smallest tables."""

from __future__ import annotations

import itertools

import corpus_pipeline
from lodestrata.llm import common, language_id, piece_transducer, quality, similar

from . import cases


def stage(part):
    return next(s for n, s in corpus_pipeline.STAGES if part in n)


def test_stages_keep_columns_and_decide(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) in (4, 5) and len(set(names)) == len(names)
    before, labels = docs, {r.doc_id: r.quality for r in common.table(spark, sf_dir, "labels").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(step(spark, before, sf_dir), f"test-{name}")
        assert after.columns == docs.columns
        a, b = {r.doc_id for r in after.collect()}, {r.doc_id for r in before.collect()}
        assert a <= b
        if name == "quality":
            gone = b - a
            assert sum(labels.get(i) == 1 for i in gone) <= 0.05 * len(gone) + 1
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert all(r.round_trip for r in last.collect()) and last.count() == before.count()


def words5(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_dedup(rows):
    """Indexes of the rows that stay: the smallest (id, position) of each component at a similarity of 0.8."""
    sets, parent = [words5(r.text) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, r in enumerate(rows):
        k = (r.doc_id is None, r.doc_id or 0, i)
        best[find(i)] = min(best.get(find(i), k), k)
    return [rows[k[2]].doc_id for k in best.values()]


def brute_leaks(rows, items):
    windows = set()
    for t in items:
        w = cases.item_words(t)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}
    out = []
    for r in rows:
        w = cases.item_words(r.text)
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            out.append(r)
    return out


def test_run_equals_brute_force(spark, sf_dir):
    """Models are trained by the operators; every decision after that is made again in plain Python."""
    from sentencepiece import SentencePieceProcessor

    docs = common.table(spark, sf_dir, "documents")
    rows = docs.collect()
    langs, scores = language_id.classify(language_id.train(language_id.training_sample(docs)), [r.text for r in rows])
    rows = [r for r, x, s in zip(rows, langs, scores, strict=True) if x != "und" and s >= corpus_pipeline.LEAST_LANGUAGE]
    kept = docs.where(docs.doc_id.isin([r.doc_id for r in rows]))
    model = quality.train(*quality.training_sample(kept, common.table(spark, sf_dir, "labels")))
    rows = [r for r, s in zip(rows, model.scores([r.text for r in rows], quality.FormCache()), strict=True) if s >= quality.CUT]
    left = set(brute_dedup(rows))
    rows = brute_leaks([r for r in rows if r.doc_id in left], [r.text for r in common.table(spark, sf_dir, "benchmark").collect()])
    library = SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((r.doc_id, library.encode(r.text)) for r in rows)
    assert 0 < len(got) < docs.count()


def test_near_dedup_goes_by_five_word_similarity(spark, sf_dir):
    """Four changed words of 200 leave a Jaccard similarity of 0.81, six others 0.73."""
    rows = []
    for i in range(20):
        words = [f"w{i}x{k}" for k in range(200)]
        changed = lambda n, at: " ".join(f"new{k}" if k % 30 == at and k < 30 * n else w for k, w in enumerate(words))  # noqa: B023, E731
        rows += [(100 + i, " ".join(words)), (200 + i, changed(4, 20)), (300 + i, changed(6, 8))]
    rows += [(1, None), (2, ""), (3, "two words"), (4, "Two  words"), (None, "two words"), (5, "one more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = stage("dedup")(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, *range(100, 120), *range(300, 320)]
    assert stage("dedup")(spark, docs.limit(0), sf_dir).count() == 0


def test_near_dedup_loses_no_link_in_a_mixed_group(spark, sf_dir):
    """Many variants of one long text: what is left equals the components by brute force."""
    import random

    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"z{rng.random()}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in stage("dedup")(spark, docs, sf_dir).collect()]
    assert sorted(got) == sorted(brute_dedup(docs.collect()))


def test_near_dedup_is_exact_where_bands_of_hashes_miss(spark, sf_dir):
    """Eight of ten shingles shared, yet no fingerprint within 4 bits and none of 40 bands of 8 minimum hashes equal (that search lost these links)."""
    rows = []
    for i in (554, 1231, 3129, 3405, 10287, 10334, 12048, 13095, 13229, 15083, 16290, 16796):
        w = [f"w{i}x{k}" for k in range(13)]
        rows += [(i, " ".join(w)), (100_000 + i, " ".join(["new", *w[1:]])), (200_000 + i, " ".join(["new", *w[1:-1], "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in stage("dedup")(spark, docs, sf_dir).collect()]
    assert sorted(kept) == sorted(brute_dedup(docs.collect())) == [r[0] for r in rows if r[0] < 100_000]


def test_simhash_links_are_candidates(spark):
    """Texts that share their fingerprint's neighbourhood meet even where no band would bring them together."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400))), (2, " ".join(f"w{i}" for i in range(402))), (3, "other words")], "doc_id long, text string")
    common.ship(spark)
    numbered = docs.selectExpr("monotonically_increasing_id() AS _row", "struct(*) AS _doc")
    classes = similar._classes(numbered, 5)
    pairs = similar._print_pairs(classes.groupBy("class").agg({"fp": "min"}).toDF("class", "fp")).collect()
    assert len(pairs) == 1


def test_stages_on_awkward_tables(spark, sf_dir):
    docs, empty = cases.awkward(spark), cases.empty(spark)
    rows = docs.collect()
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, sf_dir).count() == 0
        got = step(spark, docs, sf_dir)
        left = got.collect()
        others = [c for c in docs.columns if c != "text"]
        assert got.columns[: len(others)] == others if name == "sentencepiece" else got.columns == docs.columns
        own = {tuple(r[c] for c in others) for r in rows}
        assert all(tuple(r[c] for c in others) in own for r in left)
        texts = {r.text for r in left} if "text" in got.columns else set()
        if name == "language_id":
            assert not texts & {None, "", " \t\n ", "42 7 ..."} and cases.LONG in texts
        elif name == "near_dedup":
            assert sorted(map(str, (r.doc_id for r in left))) == sorted(map(str, brute_dedup(rows)))
        elif name == "decontaminate":
            assert len(left) == len(rows)
        elif name == "sentencepiece":
            assert len(left) == len(rows) and all(r.round_trip for r in left)
            assert piece_transducer.MARK not in "".join(c for r in left for c in str(r.score))

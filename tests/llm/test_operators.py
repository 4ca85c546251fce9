"""The ten operators against brute force, on awkward rows, empty tables and the smallest tables."""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import common, decontaminate, language_id, language_model, licence_scan, piece_transducer, quality, queries, sharding, simhash, token_frames, topk

from ..oracle import compare
from . import cases


def ids(df):
    return sorted((r.doc_id is not None, r.doc_id) for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def docs(spark):
    return cases.awkward(spark).cache()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


# --- 1 -----------------------------------------------------------------------------------------------------------


def brute_licence(text, cut=licence_scan.CUT):
    best = {}
    lines = [licence_scan.words(x) for x in (text or "").split("\n")]
    for i, (name, t) in enumerate(licence_scan.TEMPLATES.items()):
        g = licence_scan.bigrams(licence_scan.words(t))
        for a in range(len(lines)):
            for z in range(a, len(lines)):
                own = licence_scan.bigrams([w for ws in lines[a : z + 1] for w in ws])
                d = 2 * len(own & g) / (len(own) + len(g))
                if d >= cut and d > best.get(name, 0):
                    best[name] = d
    return best


def test_licence_scan_finds_what_brute_force_finds(spark, docs):
    mit = licence_scan.TEMPLATES["mit"]
    half = mit.replace(". ", ".\n").replace("MERCHANTABILITY", "merchantability")
    texts = [mit, half, "intro words here\n" + half + "\ntail of the text", "Licensed under CC BY-NC 4.0.\n" + cases.PROSE, "all rights are reserved", mit[: len(mit) // 3], None, ""]
    texts += [t for _, t, *_ in cases.rows() if t is None or len(t) < 3000]
    scanner = licence_scan.Scanner(licence_scan.TEMPLATES)
    for t in texts:
        found = {n: d for n, d, _, _ in scanner.scan(t)[0]}
        assert found == brute_licence(t)
    assert ids(licence_scan.scan(docs)) == ids(docs)
    assert licence_scan.scan(cases.empty(docs.sparkSession)).count() == 0


def test_licence_scan_keeps_dice_at_the_cut_and_runs_over_blank_lines():
    texts = ["2024 All rights reserved.", "some prose\n2024 All rights reserved.\nmore prose", "prose here\nAll\n\nrights reserved.\nprose there", "All\n \n\nrights\n\nreserved."]
    for t in licence_scan.TEMPLATES.values():
        ws = t.split()
        texts += ["x\n" + " ".join(ws + [f"z{i}" for i in range(n)]) + "\ny" for n in range(len(ws) // 2 - 2, len(ws) // 2 + 2)]
        texts += ["x\n" + " ".join(ws[:n]) + "\ny" for n in range(2 * len(ws) // 3 - 1, 2 * len(ws) // 3 + 4)]
    scanner = licence_scan.Scanner(licence_scan.TEMPLATES)
    found = [{n: d for n, d, _, _ in scanner.scan(t)[0]} for t in texts]
    assert found == [brute_licence(t) for t in texts]
    assert found[0] == {"all-rights-reserved": 0.8} and found[2] == {"all-rights-reserved": 1.0}
    assert sum(d == 0.8 for f in found for d in f.values()) >= 10


def test_licence_scan_is_linear_in_repeated_lines():
    import time

    scanner = licence_scan.Scanner(licence_scan.TEMPLATES)
    began = time.process_time()
    for line in ("the software", "copies of the software"):
        assert scanner.scan("\n".join([line] * 20000))[0] == []
    text = "\n".join(["the software", ""] * 5000 + [licence_scan.TEMPLATES["isc"]] + ["of the software"] * 5000)
    found = {n: (round(d, 6), a) for n, d, a, _ in scanner.scan(text)[0]}
    assert found == {"isc": (1.0, 10000)} and time.process_time() - began < 5


def test_licence_templates_from_a_table(spark, docs):
    table = spark.createDataFrame([("own", "one two three four"), ("none", None), ("word", "alone")], "name string, text string")
    chosen = licence_scan.templates_from(table)
    assert chosen == {"own": "one two three four"}
    rows = spark.createDataFrame([(1, "x\nOne, two; THREE four.\ny"), (2, "x"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licence_scan.scan(rows, chosen).collect()} == {1: "own", 2: None, 3: None}


# --- 2 -----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    w = cases.space_words(text)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(values, tau):
    """value -> smallest value reachable."""
    todo, label = set(values), {}
    for v in sorted(todo):
        if v in label:
            continue
        stack, label[v] = [v], v
        while stack:
            x = stack.pop()
            for y in todo:
                if y not in label and (x ^ y).bit_count() <= tau:
                    label[y] = v
                    stack.append(y)
    return label


def test_simhash_equals_brute_force(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    want = {(r[0], f"{brute_fingerprint(r[1]):016x}") for r in cases.rows()}
    assert {(r.doc_id, r.fingerprint) for r in got} == want and len(got) == len(cases.rows())
    label = brute_components([int(f, 16) for _, f in want], 4)
    smallest = {}
    for d, f in want:
        k = label[int(f, 16)]
        if d is not None:
            smallest[k] = min(smallest.get(k, d), d)
    assert all(r.component_id == smallest[label[int(r.fingerprint, 16)]] for r in got)
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_dense_fingerprints_lose_no_link(spark, m):
    rng = np.random.default_rng(m)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = []
    for i in range(900):
        v = centre[i % 6] if i < 700 else rng.integers(0, 1 << 63, dtype=np.uint64)
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            v ^= np.uint64(1) << np.uint64(b)
        values.append(int(v))
    signed = sorted({int(np.uint64(v).astype(np.int64)) for v in values})
    classes = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.near_edges(classes, 4, m).collect()
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 4 for e in edges)
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[max(find(e.a), find(e.b))] = min(find(e.a), find(e.b))
    label = brute_components([v & (2**64 - 1) for v in signed], 4)
    groups = {}
    for v in signed:
        groups.setdefault(label[v & (2**64 - 1)], set()).add(find(v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("hot", [3, 40])
def test_split_keys_lose_no_link(spark, hot):
    """Far fewer index rows than usual make a key hot, so that most keys are split."""
    rng = np.random.default_rng(hot)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    values = {int(c) for c in centre}
    for i in range(1200):
        v = centre[i % 4] if i < 1000 else rng.integers(0, 1 << 63, dtype=np.uint64)
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            v ^= np.uint64(1) << np.uint64(b)
        values.add(int(v))
    signed = sorted(int(np.uint64(v).astype(np.int64)) for v in values)
    edges = simhash.near_edges(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, 3, hot).collect()
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 4 for e in edges)
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[max(find(e.a), find(e.b))] = min(find(e.a), find(e.b))
    label = brute_components([v & (2**64 - 1) for v in signed], 4)
    pairs = {(label[v & (2**64 - 1)], find(v)) for v in signed}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_simhash_ignores_other_columns(spark):
    rows = [(1, "a b c d e", "text", 2.5), (2, "a b c d e", None, None), (3, None, "x", 1.0)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, row string, fp double")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(clash).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


# --- 3 -----------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    vectors += [(i, [0.25] * 6) for i in range(1000, 1060)]  # ties
    vectors += [(400, None), (401, [float("nan")] * 6), (402, [float("inf")] + [0.0] * 5), (403, [None] + [0.1] * 5), (None, [1.0] * 6), (404, []), (450, [0.0] * 6)]
    vectors += [vectors[10], vectors[100], (150, [0.5] * 6), (2000, [30.0] * 6), (2000, [30.0] * 6)]  # repeated rows, ids and queries
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    good = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * float(np.float32(x))) for x in v] or [0] * 6))
    want = []
    for q, own in good:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in good if i != q)[:5]
            want += [(q, k + 1, i, -score) for k, (score, i) in enumerate(s)]
    want.sort()
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_counts_repeated_rows(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r)[1:3] for r in topk.top_k(df).collect()) == [(1, 1), (2, 1), (3, 2)]


def test_top_k_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(8)
    m = rng.integers(-40, 40, (700, 5))
    df = spark.createDataFrame([(i, [float(x) / 256 for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    want = []
    for q in range(0, 700, 50):
        s = sorted((-int(m[q] @ m[i]), i) for i in range(700) if i != q)[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == want


def test_threshold_stops_early():
    matrix = np.zeros((5000, 4), np.int64)
    matrix[:, 0] = np.arange(5000)
    lists = topk.Lists(np.arange(5000), matrix)
    found, scored = lists.top(np.array([3, 0, 0, 0]), -1, 5)
    assert [i for _, i in found] == [4999, 4998, 4997, 4996, 4995] and scored < 100


# --- 4 -----------------------------------------------------------------------------------------------------------


def test_language_model_base_is_exact(spark, docs):
    tokens = lambda t: [*cases.space_words(t), "\n"]
    counts = Counter(w for r in cases.rows() if cases.fold(r[0], 5) != 1 for w in tokens(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for r in cases.rows():
        t = tokens(r[1])
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        want.append((r[0], cases.fold(r[0], 5) == 1, len(t), sum(counts[w] > 0 for w in t), total, round(base, 5)))
    got = language_model.score_documents(docs).collect()
    assert cases.key([(*tuple(r)[:5], round(r.base_score, 5)) for r in got]) == cases.key(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert language_model.score_documents(cases.empty(spark)).count() == 0


def test_filter_reads_back_quantised_counts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    n = np.maximum(1, rng.pareto(1.0, len(h)) * 3).astype(np.int64)
    bits = 2048
    seg = (language_model.mix(h) % np.uint64(language_model.SEGMENTS)).astype(int)
    lowest, data = np.ones(language_model.SEGMENTS, np.int64), np.zeros(language_model.SEGMENTS * bits // 8, np.uint8)
    for s in np.unique(seg):
        lowest[s], own = language_model.build_segment(h[seg == s], n[seg == s], bits)
        data[s * bits // 8 : (s + 1) * bits // 8] = own
    found = language_model.Filter(bits, lowest, data).counts(h)
    exact = language_model.count_of(language_model.level_of(n))
    assert (found >= exact - 1e-9).all()  # no false negatives
    assert (found == exact).mean() > 0.98
    unseen = language_model.Filter(bits, lowest, data).counts(rng.integers(0, 1 << 63, 20000, dtype=np.uint64))
    assert (unseen > 0).mean() < 0.02


def test_full_segments_raise_their_lowest_level():
    rng = np.random.default_rng(2)
    h, n = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), np.concatenate([np.ones(4900, np.int64), np.full(100, 9)])
    lowest, _ = language_model.build_segment(h, n, 4096)
    assert 1 < lowest <= language_model.level_of(np.array([9]))[0]


def test_score_uses_exact_words_and_every_pair(spark, docs):
    tokens = lambda t: [*cases.space_words(t), "\n"]
    train = [tokens(r[1]) for r in cases.rows() if cases.fold(r[0], 5) != 1]
    ones, twos = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["", *t], t, strict=False))
    ones[""] = len(train)
    total, distinct = sum(map(len, train)), len(ones) - 1
    quantised = lambda c: float(language_model.count_of(language_model.level_of(np.array([c])))[0]) if c else 0.0
    want = []
    for r in cases.rows():
        t, score = tokens(r[1]), 0.0
        for v, w in zip(["", *t], t, strict=False):
            p = (ones[w] + 0.5) / (total + 0.5 * (distinct + 1))
            score += math.log10(min(1, (min(quantised(twos[v, w]), ones[v], ones[w]) + language_model.MU * p) / (ones[v] + language_model.MU)))
        want.append((r[0], round(score, 5)))
    assert cases.key([(r.doc_id, round(r.score, 5)) for r in language_model.score_documents(docs).collect()]) == cases.key(want)


def test_large_segments_keep_their_rarest_pairs():
    h = np.random.default_rng(3).integers(0, 1 << 63, 60000, dtype=np.uint64)
    n = np.where(np.arange(60000) < 50000, 1, 9).astype("<u4")
    first, second = language_model.answer_pairs([h, h[:100]], [n, np.zeros(100, "<u4")])
    level = language_model.integers(first, 1).astype(int)
    assert (level >= language_model.level_of(n.astype(int))).all() and (level == language_model.level_of(n.astype(int))).mean() > 0.98
    assert (language_model.integers(second, 1) == level[:100]).all()


def test_model_beats_base_on_held_out(spark, sf_dir):
    rows = [r for r in language_model.score_documents(common.table(spark, sf_dir, "documents")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# --- 5 -----------------------------------------------------------------------------------------------------------


def test_language_gradients():
    model = language_id.init(["a", "b"])
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    rng = np.random.default_rng(0)
    codes, mask, labels = rng.integers(0, 256, (5, 2)), np.ones((5, 2)), np.array([0, 1])
    _, grads = language_id.gradients(model, codes, mask, labels)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        shifted = []
        for e in (1e-5, -1e-5):
            model.params[k][at] += e
            shifted.append(language_id.gradients(model, codes, mask, labels)[0])
            model.params[k][at] -= e
        assert abs((shifted[0] - shifted[1]) / 2e-5 - g[at]) < 1e-6


def test_language_id_on_held_out_rows(spark, sf_dir):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.language_id(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(r.held_out == (cases.fold(r.doc_id, 4) == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_letters_are_what_python_calls_alphabetic():
    model = language_id.init(["a", "b"])
    langs, scores = language_id.classify(model, ["²½ Ⅷ", "42 _", None, "", "漢", "é²"])
    assert [x == "und" for x in langs] == [True, True, True, True, False, False] and scores[:4] == [0.0] * 4


def test_language_sample_is_bounded(spark):
    assert cases.fold(8, 4) != 2
    rows = [(8, f"text {i % 3}", "en") for i in range(3000)] + [(i, f"words {i}", "de") for i in range(100, 2100)] + [(5, "x", None), (6, None, "en"), (None, "abc", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    got = language_id.training_sample(docs, per_language=20)
    counts = Counter(lang for _, lang in got)
    assert counts["de"] == 20 and counts["en"] == 1 and len(got) == len(set(got)) and got == language_id.training_sample(docs.repartition(3), per_language=20)
    assert {lang for _, lang in language_id.training_sample(docs, languages=1)} == {"de"}


def test_language_id_trains_on_every_window(monkeypatch):
    seen = []
    real = language_id.gradients
    monkeypatch.setattr(language_id, "gradients", lambda m, codes, mask, labels: seen.extend(map(bytes, codes.T.astype(np.uint8))) or real(m, codes, mask, labels))
    text = "".join(chr(97 + i % 26) + str(i) for i in range(4000))
    language_id.train([(text, "en"), ("kurz", "de")], steps=1)
    assert {bytes(w) for w in language_id.windows(text.encode())[0]} <= set(seen)


def test_language_id_on_awkward_rows(spark, docs):
    got = language_id.language_id(docs).collect()
    assert cases.key([(r.doc_id,) for r in got]) == cases.key([(r[0],) for r in cases.rows()])
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {0, 1, 2, 8} <= und and all(0 <= r.score <= 1 for r in got) and 3 not in und
    assert language_id.language_id(cases.empty(spark)).count() == 0


# --- 6 -----------------------------------------------------------------------------------------------------------


def test_transducer_equals_the_library(spark, docs):
    import random

    from sentencepiece import SentencePieceProcessor

    path = common.tokenizer_path("piece_bpe_32k.model")
    machine, sp = piece_transducer.Transducer(path), SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    signs = "ab the of  \n\t é ñ\U0001f600漢字 ing tion ▁▁ <s> 123 .,!XQZ   "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(400)] + [r[1] or "" for r in cases.rows()]
    got = [np.frombuffer(x, "<i4").tolist() for x in machine.encode(texts)]
    assert got == sp.encode(texts)
    assert [machine.decode(x) for x in machine.encode(texts)] == [t.replace("▁", " ") for t in texts]
    rows = piece_transducer.encode(docs, path).collect()
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in rows) and len(rows) == len(cases.rows())
    assert piece_transducer.sentencepiece(cases.empty(spark), path).count() == 0


def test_transducer_survives_its_cache_limits(monkeypatch):
    path = common.tokenizer_path("piece_bpe_32k.model")
    whole = piece_transducer.Transducer(path).encode([cases.LONG, cases.PROSE])
    monkeypatch.setattr(piece_transducer, "CACHE_BYTES", 3)
    monkeypatch.setattr(piece_transducer, "STABLE_BYTES", 3)
    machine = piece_transducer.Transducer(path)
    assert [machine.encode([t])[0] for t in (cases.LONG, cases.PROSE, cases.LONG)] == [*whole, whole[0]]


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("bytes_too", [True, False])
def test_other_models_equal_the_library(tmp_path, kind, rule, bytes_too):
    """Unigram and BPE, with the library's own character maps, with and without byte fallback."""
    import random

    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, rules = pb.ModelProto(), pb.ModelProto()
    with open(common.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    rules.ParseFromString(sp.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.CopyFrom(rules.normalizer_spec)
    proto.trainer_spec.model_type = kind
    proto.trainer_spec.byte_fallback = bytes_too
    kept = [p for p in proto.pieces if (bytes_too or p.type != pb.ModelProto.SentencePiece.BYTE) and (p.score > -1e8 or len(p.piece) == 1)]
    rng = random.Random(kind)
    if kind == 1:
        for p in kept:
            p.score = -rng.random() * 12 if p.type == pb.ModelProto.SentencePiece.NORMAL else 0
    del proto.pieces[:]
    proto.pieces.extend(kept)
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    machine, library = piece_transducer.Transducer(path), sp.SentencePieceProcessor(model_file=path)
    signs = "ab The of  \n\t é ñ Ｈ① ｶﾞ e\u0301 \u3000 😀漢字𒀀𒀁 ing tion ﬁ 123 .,!XQZ ß İ   "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", " ", "\t", "𒀀𒀁 𒀀", "   a   b  "]
    assert [np.frombuffer(x, "<i4").tolist() for x in machine.encode(texts)] == library.encode(texts)
    if bytes_too:
        assert [machine.decode(x) for x in machine.encode(texts)] == [machine.plain(t) for t in texts] == [library.decode(library.encode(t)) for t in texts]


def test_borders_agree_with_merging():
    """The compiled edges tell for pairs of pieces what merging their characters gives."""
    import random

    machine = piece_transducer.Transducer(common.tokenizer_path("piece_bpe_32k.model"))

    def merged(text):
        parts = list(text)
        while True:
            found = [(-machine.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in machine.score]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(3)
    pieces = rng.sample(sorted(machine.left), 4000)
    for a, b in zip(pieces[::2], pieces[1::2], strict=True):
        assert machine.apart(a, b) == (merged(a + b) == [a, b])
    for a in [p for p in machine.left if len(p) < 3][:1500]:
        assert machine.apart(a, a) == (merged(a + a) == [a, a])


def test_a_position_is_reached_by_one_state_and_texts_share_their_beginnings(monkeypatch):
    """What lets the walk stop at a position's first state: relaxing every arc finds no second one. And a text walks only what parts it from the one before."""
    import random

    machine = piece_transducer.Transducer(common.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(9)
    for _ in range(150):
        text = "▁" + "".join(rng.choice(["th", "e", "ing", "ion", "a", "é", "漢", "123", "ab", "zz", "ST", "."]) for _ in range(rng.randint(1, 9)))
        ends = [{""}] + [set() for _ in text]
        for at in range(len(text)):
            for last in ends[at]:
                for piece in machine._arcs(text, at):
                    if machine.weight(last, piece) == 1.0:
                        ends[at + len(piece)].add(piece)
        assert all(len(states) == 1 for states in ends[1:])
        path = machine.shortest_path(text)
        assert path == machine._least_path(text) and "".join(path) == text and path[-1] in ends[-1]
    steps = []
    step = machine._step
    monkeypatch.setattr(machine, "_step", lambda node, c: steps.append(c) or step(node, c))
    shared = "▁" + "qzx" * 1000
    assert machine._only_path(shared + "a") and steps.clear() is None and machine._only_path(shared + "b")
    assert len(steps) <= 3  # one character, and the shorter ends it has


def test_a_path_that_merging_never_gives_falls_back_to_characters(monkeypatch):
    machine = piece_transducer.Transducer(common.tokenizer_path("piece_bpe_32k.model"))
    monkeypatch.setattr(machine, "apart", lambda last, piece: False)
    assert machine.shortest_path("zqxj漢") == list("zqxj漢")


# --- 7 -----------------------------------------------------------------------------------------------------------


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = common.tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted((r for r in token_frames.token_output(docs, path).collect()), key=lambda r: r.start)
    from pyspark.sql import functions as F

    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    ordered = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1] or ""))
    start = 0
    for r, g in zip(ordered, got, strict=True):
        raw = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert tuple(g) == (r[0], start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    assert token_frames.token_output(cases.empty(spark), path).count() == 0


def test_encoder_survives_its_cache_limits(monkeypatch):
    path = common.tokenizer_path("byte_bpe_50k.json")
    texts = [cases.LONG, cases.PROSE, "other words entirely", cases.LONG]
    whole = token_frames.Encoder(path)._encode(texts)
    monkeypatch.setattr(token_frames, "CACHE_BYTES", 3)
    e = token_frames.Encoder(path)
    assert [e([t])[0] for t in texts] == whole and e(texts) == whole


def test_special_tokens_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    path = common.tokenizer_path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext> no", "plain words"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_frames.Encoder(path)(texts)] == want and want[1] == [50256]


def test_token_files_of_one_repeated_id_and_of_a_path_without_scheme(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(300)] + [(i, "x") for i in range(20)], "doc_id long, text string")
    path = common.tokenizer_path("byte_bpe_50k.json")
    manifest = common.materialize(token_frames.write_token_files(docs, str(tmp_path / "tokens"), path, files=4), "m")
    assert manifest.count() > 1 and len(list((tmp_path / "tokens").glob("*.tok.zst"))) == manifest.count()
    got = sorted(token_frames.read_token_files(spark, manifest, str(tmp_path / "tokens")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == 320
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_frames_are_read_alone_and_checked(tmp_path):
    from pyarrow import fs

    local = fs.LocalFileSystem()
    name = str(tmp_path / "x")
    with local.open_output_stream(name) as sink:
        w = token_frames.FrameWriter(sink, frame_bytes=64)
        for d in range(100):
            w.add(d, np.arange(d % 7 + 1, dtype="<u4").tobytes())
        w.close()
    with local.open_input_file(name) as source:
        r = token_frames.FrameReader(source)
        assert np.frombuffer(r.find(50)[0], "<u4").tolist() == list(range(50 % 7 + 1)) and r.frames_read == 1
    raw = bytearray(open(name, "rb").read())
    raw[20] ^= 255
    open(name, "wb").write(raw)
    with local.open_input_file(name) as source, pytest.raises(Exception):  # noqa: B017
        list(token_frames.FrameReader(source))


# --- 8 -----------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = common.table(spark, sf, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.quality(common.table(spark, sf, "documents"), labels).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 3, "doc_id long, quality int")
    texts, marks = quality.training_sample(docs, labels, most=20)
    assert len(texts) == len(marks) <= 20
    assert (texts, marks) == quality.training_sample(docs.repartition(5), labels, most=20)


def test_quality_words_tell_what_forms_cannot():
    good, bad = [f"alpha beta gamma{i}" for i in range(30)], [f"omega sigma delta{i}" for i in range(30)]
    labels = [1] * 25 + [0] * 25
    model = quality.train(good[:25] + bad[:25], labels)
    s = model.scores(good[25:] + bad[25:], quality.FormCache())
    assert (s[:5] > 0.5).all() and (s[5:] < 0.5).all()


def test_form_cache_is_bounded_in_bytes(monkeypatch):
    texts = [" ".join(f"w{i}x{k}" for k in range(50)) for i in range(40)]
    whole = quality.features(texts, quality.FormCache())
    monkeypatch.setattr(quality, "CACHE_BYTES", 1000)
    forms = quality.FormCache()
    assert all((a == b).all() for a, b in zip(whole, quality.features(texts, forms), strict=True)) and len(forms) < 10


def test_quality_on_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(3, 1, 0), (4, None, 0), (5, 0, 1), (5, 0, 1), (6, 0, 0), (9, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    assert ids(quality.quality(docs, labels)) == ids(docs)
    assert {round(r.score, 6) for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(cases.empty(spark), labels).count() == 0


# --- 9 -----------------------------------------------------------------------------------------------------------


def test_allot_equals_the_heap():
    rng = np.random.default_rng(9)
    for _ in range(50):
        classes = [(int(s), int(rng.integers(1, 400))) for s in rng.choice(np.arange(1, 500), 12, replace=False)]
        loads = [0] * 8
        heap = [(0, i) for i in range(8)]
        for s, n in sorted(classes, reverse=True):
            for _ in range(n):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + s, i))
        for s, taken in sharding.allot(classes, 8):
            for i, t in enumerate(taken):
                loads[i] += s * t
        assert sorted(loads) == sorted(load for load, _ in heap)


def test_sharding_of_awkward_rows(spark, docs):
    got = sharding.shard_documents(docs).collect()
    want = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in cases.rows()]
    assert cases.key([tuple(r)[:3] for r in got]) == cases.key(want)
    by_shard, by_text = {}, {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        by_text.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and set(by_shard) <= set(range(8))
    assert all(len(s) == 1 for k, s in by_text.items() if k[1] > 1)
    assert sharding.shard_documents(cases.empty(spark)).count() == 0


# --- 10 ----------------------------------------------------------------------------------------------------------


def brute_contamination(documents, items):
    windows = {}
    for i, t in items:
        w = cases.item_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in documents:
        w, hit, found = cases.item_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_equals_brute_force(spark, docs):
    items = [(1, cases.PROSE), (2, "Lazy Dog"), (10, "fox-jumps over"), (3, None), (4, "..."), (5, "seven"), (6, " ".join(cases.LONG.split()[100:130])), (1, cases.PROSE), (7, "école ÉCOLE éèê")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.contamination(docs, bench).collect()]
    want = brute_contamination([(r[0], r[1]) for r in cases.rows()], items)
    assert cases.key(got) == cases.key(want)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and cases.key([(r.doc_id,) for r in kept.collect()]) == cases.key([(w[0],) for w in want if not w[5]])
    assert decontaminate.contamination(cases.empty(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_winnowing_guarantee(spark):
    """Texts that share a run of ten words share a winnowed fingerprint."""
    rng = np.random.default_rng(4)
    shared = [f"s{i}" for i in range(10)]
    pairs = []
    for i in range(60):
        pad = lambda: [f"p{x}" for x in rng.integers(0, 10**9, rng.integers(0, 30))]
        pairs.append((i, [*pad(), *shared, *pad()], [*pad(), *shared, *pad()]))
    df = spark.createDataFrame(pairs, "i long, a array<string>, b array<string>")
    a = {r.i: set(r._marks) for r in decontaminate.marks(df, "a", [10], ["i"]).collect()}
    b = {r.i: set(r._marks) for r in decontaminate.marks(df, "b", [10], ["i"]).collect()}
    assert all(a[i] & b[i] for i in a)

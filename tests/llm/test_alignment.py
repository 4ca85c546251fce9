"""Operator 13 against an alignment of every whole text, counted in Python."""

import collections
import hashlib

import pytest

from lodestrata.llm import alignment, common, queries

from . import cases

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(common.tokenizer_path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(B))


def brute(texts, libraries):
    a, b = libraries
    as_byte = alignment.byte_characters()
    docs = []
    for text in texts:
        docs.append(None)
        if not text:
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = [bytes(as_byte[c] for c in a.id_to_token(i)) for i in ids[0]], [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]
        ]
        if any(b"".join(side) != (" " + text).encode() for side in raw):
            continue
        groups, own, at = [], ([], []), [0, 0]
        left = [list(zip(i, map(len, r), strict=True)) for i, r in zip(ids, raw, strict=True)]
        while left[0] or left[1]:
            side = 0 if at[0] <= at[1] and left[0] else 1
            token, size = left[side].pop(0) if len(left[side]) < 2000 else left[side].pop(0)
            own[side].append(token)
            at[side] += size
            if at[0] == at[1]:
                groups.append(own)
                own = [], []
        docs[-1] = (*map(len, ids), groups)
    held = collections.Counter(k for d in docs if d for k in {(x, y) for g in d[2] for x in g[0] for y in g[1]})
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g in d[2] for x in g[0] for y in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in d[2])
        out.append((d[0], d[1], len(d[2]), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


ODD = [
    None, "", " ", "  a  b", "\n x\ty ", "ab " * 100 + "  ", "é▁x y", "<s> </s> <|endoftext|> z", "漢字" * 300, "x y 　 z", " lead", "trail ",
    "a b\r\nc", "\U0001f642\U0001f642 ok", "\x1c a \x1d b", "a  b", "a" * 5000, "ab1" * 3000, "x\x00y", "don't we'll", "a b", "a b", "ﬁne ²",
]


def test_odd_texts(spark, libraries):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    found = sorted(tuple(r) for r in alignment.align(df, common.tokenizer_path(A), common.tokenizer_path(B)).collect())
    assert [r[1:] for r in found] == brute(ODD, libraries)


def test_awkward_table(spark, libraries):
    texts = [r[1] for r in cases.rows()]
    found = alignment.align(cases.awkward(spark), common.tokenizer_path(A), common.tokenizer_path(B))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert cases.key(tuple(r)[1:] for r in found.collect()) == cases.key(brute(texts, libraries))
    assert alignment.align(cases.empty(spark), common.tokenizer_path(A), common.tokenizer_path(B)).count() == 0


def test_query(spark, sf_dir, libraries):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    wanted = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows], libraries), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op13_tokenizer_alignment(spark, sf_dir).collect()} == wanted


def test_a_small_cache_changes_nothing(libraries):
    aligner = alignment.Aligner(common.tokenizer_path(A), common.tokenizer_path(B))
    texts = [f"{cases.PROSE} {i} {cases.WORDS[i % 16] * (i % 5)}" for i in range(40)]
    whole = aligner(texts)
    wanted = list(zip(whole.doc.tolist(), whole.keys.tolist(), whole.weights.tolist(), strict=True))
    pieces = []
    for i, t in enumerate(texts):
        aligner.forget()
        own = aligner([t])
        pieces += [(i, k, w) for k, w in zip(own.keys.tolist(), own.weights.tolist(), strict=True)]
    assert pieces == wanted


def test_long_groups_are_counted_by_their_different_ids(monkeypatch):
    aligner = alignment.Aligner(common.tokenizer_path(A), common.tokenizer_path(B))
    texts = [cases.PROSE, "wizardsquirrel" * 40, "漢字" * 50]
    wanted = [(w.keys.tolist(), w.weights.tolist()) for w in map(aligner, ([t] for t in texts))]
    monkeypatch.setattr(alignment, "LONG_GROUP", 0)
    monkeypatch.setattr(alignment, "OUTER", 2)
    aligner.forget()
    assert [(w.keys.tolist(), w.weights.tolist()) for w in map(aligner, ([t] for t in texts))] == wanted


def test_shards_find_every_key(spark, tmp_path):
    rows = [(k * 37 % 1000, 1 + k % 3) for k in range(4000)]
    partial = spark.createDataFrame(rows, "key long, n long").repartition(7)
    before, alignment.SHARD_KEYS = alignment.SHARD_KEYS, 900
    try:
        made = alignment.write_shards(partial, tmp_path.as_uri()).collect()
    finally:
        alignment.SHARD_KEYS = before
    shards = alignment.Shards(tmp_path.as_uri(), list({(r["first"], r["last"], r["shard"], r["size"]) for r in made}))
    wanted = collections.Counter()
    for k, n in rows:
        wanted[k] += n
    keys = sorted(wanted)
    assert len(shards.manifest) > 1
    import numpy as np

    assert shards.counts(np.array(keys)).tolist() == [wanted[k] for k in keys]
    with pytest.raises(ValueError):
        shards.counts(np.array([5000 - 4001]) if 999 not in wanted else np.array([-1]))

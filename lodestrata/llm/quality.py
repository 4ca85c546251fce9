"""Operator 8: quality classifier by naive Bayes support vectors (NB-SVM).

Features are indicators of n-grams, hashed to ``BINS`` bins: of the words
themselves (lower-cased, without trailing punctuation; n = 1 and 2) and of
their *form* (n = 1 to 3). The form of a word is its case pattern, trailing
punctuation, length class and whether it repeats one of the two words before
it, so that invented or unseen words share features with known ones.
Indicators are scaled by the log-count ratio of their bin between the classes,
a linear hinge loss is fitted on them by dual coordinate descent, the weights
are interpolated with their mean magnitude, and a logistic curve fitted on the
training margins turns the margin into a score.

The labelled rows to learn from are bounded: at most ``MAX_LABELLED`` pairs of an
id and a label, chosen by a hash of the id, one text for each (of rows that share
an id the text with the smallest hash). Scoring reads every whole text. The model
is one float per bin, whatever the corpus.

Defined cases: null and empty texts have no features and get the score of the
intercept; without labels of both classes every score is the share of label 1
(0.5 without labels); ids with several labels count once per distinct label;
repeated rows are each scored, equal texts alike; very long texts are read whole,
``SLICE_BYTES`` of text at a time at most beside one text; of labels tied on an id
and its hash the smaller comes first; an empty table gives no rows; other columns
are ignored and keep their values under clashing names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BINS = 1 << 18
MAX_LABELLED = 3000
CUT = 0.3
CACHE_BYTES = 12 << 20
SLICE_BYTES = 1 << 20
TRAIN_SLICE = 256
MULT = np.uint64(0x9E3779B97F4A7C15)


def symbol(word: str) -> int:
    """The form of a word as a 32-bit number."""
    core = word.rstrip(".,;:!?*$%&#|\"')(]}-_=+<>/\\~^@`")
    tail = word[len(core) :][:3]
    if not core or not any(c.isalpha() for c in core):
        case = "d" if any(c.isdigit() for c in core) else "x"
    elif core.isupper() and len(core) > 1:
        case = "U"
    elif core[0].isupper():
        case = "C" if core[1:].islower() or len(core) == 1 else "M"
    else:
        case = "l" if core.islower() else "M"
    length = sum(len(core) > k for k in (0, 2, 5, 9, 20))
    return zlib.crc32(f"{case}{length}{tail}".encode())


class FormCache(dict):
    """word -> its form in the high half and the word itself in the low half of 64 bits; bounded in bytes."""

    held = 0

    def __missing__(self, word: str) -> int:
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        core = word.rstrip(".,;:!?*").lower() or word
        self[word] = out = symbol(word) << 32 | zlib.crc32(core.encode("utf-8", "surrogatepass"))
        self.held += 2 * len(word) + 200
        return out


def _bins(gram: np.ndarray, kind: int) -> np.ndarray:
    mixed = (gram ^ (gram >> np.uint64(31))) * MULT + np.uint64(kind)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MULT
    return (mixed >> np.uint64(46)).astype(np.int64)


def _grams(sym: np.ndarray, doc: np.ndarray, most: int, kind: int) -> Iterator[np.ndarray]:
    """doc * BINS + bin of every n-gram inside a text, n = 1 to ``most``."""
    gram = sym
    for size in range(1, min(most, len(sym)) + 1):
        if size > 1:
            gram = gram[:-1] * MULT + sym[size - 1 :]
        first, last = doc[: len(doc) - size + 1], doc[size - 1 :]
        inside = first == last
        yield first[inside] * BINS + _bins(gram[inside], kind + size)


def features(texts: list[str | None], forms: FormCache, with_words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bin) of every distinct feature, sorted by text."""
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = (t or "").split()
        counts[i] = len(own)
        words.extend(own)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.fromiter(map(forms.__getitem__, words), np.uint64, n)
    doc = np.repeat(np.arange(len(texts)), counts)
    repeat = np.zeros(n, np.uint64)
    for back in (1, 2):
        same = (both[back:] == both[:-back]) & (doc[back:] == doc[:-back])
        repeat[back:] += same.astype(np.uint64) << np.uint64(back - 1)
    keys = list(_grams((both >> np.uint64(32)) * np.uint64(4) + repeat, doc, 3, 0))
    if with_words:
        keys += _grams(both & np.uint64(0xFFFFFFFF), doc, 2, 8)
    found = np.unique(np.concatenate(keys))
    return found // BINS, found % BINS


@dataclass
class Model:
    weights: np.ndarray  # ratio * svm weight per bin
    bias: float
    slope: float
    shift: float

    def margins(self, texts: list[str | None], forms: FormCache) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        rows, bins = features(texts, forms)
        # The root of the feature count keeps long and short texts on one scale.
        sums = np.bincount(rows, self.weights[bins], len(texts))
        sizes = np.sqrt(np.maximum(np.bincount(rows, minlength=len(texts)), 1))
        return out + sums / sizes

    def scores(self, texts: list[str | None], forms: FormCache) -> np.ndarray:
        z = np.clip(self.slope * self.margins(texts, forms) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))


def dual_coordinate_descent(indptr: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of min |w|^2/2 + c * sum hinge(y (w x + b)), the intercept as one more weight."""
    w, b = np.zeros(BINS), 0.0
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(seed)
    rows = [(idx[a:z], val[a:z]) for a, z in zip(indptr[:-1], indptr[1:], strict=True)]
    norms = np.array([float(v @ v) + 1 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            j, v = rows[i]
            g = y[i] * (float(w[j] @ v) + b) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                w[j] += step * v
                b += step
                alpha[i] = new
        if moved < 1e-3 * c:
            break
    return w, b


def train(texts: list[str | None], labels: list[int], c: float = 1.0, epochs: int = 30, beta: float = 0.5, seed: int = 11, with_words: bool = True) -> Model:
    y = np.array([1.0 if v == 1 else -1.0 for v in labels])
    share = float((y > 0).mean()) if len(y) else 0.5
    flat = Model(np.zeros(BINS), 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not len(y) or share in (0.0, 1.0):
        return flat
    forms = FormCache()
    counts, parts = [], []
    for lo in range(0, len(texts), TRAIN_SLICE):  # a slice at a time, as the driver holds few texts' words at once
        own = texts[lo : lo + TRAIN_SLICE]
        rows, bins = features(own, forms, with_words)
        counts.append(np.bincount(rows, minlength=len(own)))
        parts.append(bins.astype(np.int32))
    sizes, bins = np.concatenate(counts), np.concatenate(parts)
    positive = np.repeat(y > 0, sizes)
    p = 1 + np.bincount(bins[positive], minlength=BINS)
    q = 1 + np.bincount(bins[~positive], minlength=BINS)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p == 1) & (q == 1)] = 0  # bins never seen say nothing
    indptr = np.concatenate([[0], np.cumsum(sizes)])
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    val = ratio.astype(np.float32)[bins] * np.repeat(scale.astype(np.float32), sizes)
    w, b = dual_coordinate_descent(indptr, bins, val, y, c, epochs, seed)
    seen = (p > 1) | (q > 1)
    w = np.where(seen, (1 - beta) * np.abs(w[seen]).mean() + beta * w, 0.0)
    model = Model(w * ratio, beta * b, 1.0, 0.0)
    sums = np.add.reduceat(np.concatenate([model.weights[bins], [0.0]]), indptr[:-1]) * (sizes > 0)
    m = model.bias + sums * scale
    target = (y + 1) / 2
    a, s = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic curve
        pr = 1 / (1 + np.exp(-np.clip(a * m + s, -30, 30)))
        g = np.array([((pr - target) * m).sum() + 1e-3 * a, (pr - target).sum()])
        v = pr * (1 - pr) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, s = a - step[0], s - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(a), float(s)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[list[str | None], list[int]]:
    """At most ``most`` labelled texts outside the held-out fold, chosen by a hash of the id."""
    known = labels.where(F.col("quality").isNotNull() & (common.fold("doc_id", 5) != 0)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    # One text for each pair, whatever the copies of an id: map-side aggregation, so at most ``most`` rows a task leave it.
    text = F.min_by("text", F.xxhash64("text")).alias("text")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(text).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    return [r["text"] for r in rows], [r["quality"] for r in rows]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample, trained on the driver, which then gives its memory back."""
    model = train(*training_sample(docs, labels))
    common.give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (all columns) with ``score`` and ``predicted`` added."""
    common.ship(docs.sparkSession)
    score_name, predicted_name = common.free_name(docs, "score"), common.free_name(docs, "predicted")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{score_name} double", f"{predicted_name} int"])
    light = Model(model.weights.astype(np.float32), model.bias, model.slope, model.shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = FormCache()
        for whole in batches:
            for batch in common.slices(whole, SLICE_BYTES):
                s = light.scores(batch.column("text").to_pylist(), forms)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], [*batch.schema.names, score_name, predicted_name])

    return docs.mapInArrow(common.tidy(run), schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit(docs, labels)
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (common.fold("doc_id", 5) == 0).alias("held_out")), model)
    return found.select("doc_id", "held_out", "score", "predicted")

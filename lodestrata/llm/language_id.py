"""Operator 5: language identification by a bidirectional gated recurrent network over bytes.

Texts are read as UTF-8 bytes in consecutive windows of ``WINDOW`` bytes that
cover the whole text. A forward and a backward GRU run over each window, a
softmax labels every position from both states, and a document's probabilities
are the mean over all its positions. Training is numpy backpropagation through
time with Adam, on a bounded sample of labelled rows: at most ``PER_LANGUAGE``
ids for each of at most ``MOST_LANGUAGES`` languages (those of most ids),
chosen by a hash of the id, one whole text for each. Training passes once at
least over every window of these texts. The weights (some 13,000 floats,
whatever the corpus) travel with the task.

Defined cases: text null or without a letter (``str.isalpha``) gives ``und``
with score 0; with no labelled row at all every text is ``und``; repeated rows
are each scored, equal texts alike; very long texts are read to their end,
``SLICE_BYTES`` of text at a time at most beside one text; languages tied on
probability give the first in sorted order; null ids count as the text '' in
the fold; an empty table gives no rows; other columns are ignored and keep
their values under clashing names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 64
HIDDEN = 8
PER_LANGUAGE = 200
MOST_LANGUAGES = 256
STEPS = 160
BATCH = 160
SLICE_BYTES = 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    np.add(x, 0.5, out=x)
    return x


@dataclass
class Model:
    """Per direction: byte inputs w[gate] (256, H), recurrent u[gate] (H, H), bias b[gate] (H); then the softmax."""

    languages: list[str]
    params: dict[str, np.ndarray]


def init(languages: list[str], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        for g in "rzn":
            p[f"w{g}{d}"] = rng.normal(0, 0.3, (256, HIDDEN)).astype(np.float32)
            p[f"u{g}{d}"] = (rng.normal(0, 1, (HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        p[f"o{d}"] = rng.normal(0, 0.3, (HIDDEN, len(languages))).astype(np.float32)
    p["bias"] = np.zeros(len(languages), np.float32)
    return Model(languages, p)


def run_direction(p: dict[str, np.ndarray], d: str, codes: np.ndarray, tape: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) of one direction over codes (T, B); the backward one runs from the end."""
    steps, batch = codes.shape
    states = np.empty((steps, batch, HIDDEN), p["wrf"].dtype)
    h = np.zeros((batch, HIDDEN), states.dtype)
    gates, pushed = np.empty((2, 2, batch, HIDDEN), states.dtype)
    n, rh, update = np.empty((3, batch, HIDDEN), states.dtype)
    both = np.stack([p[f"ur{d}"], p[f"uz{d}"]])
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        if tape is not None:
            gates, n = np.empty_like(gates), np.empty_like(n)
        at = codes[t]
        np.take(p[f"wr{d}"], at, axis=0, out=gates[0], mode="clip")
        np.take(p[f"wz{d}"], at, axis=0, out=gates[1], mode="clip")
        np.matmul(h, both, out=pushed)
        np.add(gates, pushed, out=gates)
        r, z = _sigmoid(gates)
        np.multiply(r, h, out=rh)
        np.take(p[f"wn{d}"], at, axis=0, out=n, mode="clip")
        np.matmul(rh, p[f"un{d}"], out=update)
        np.add(n, update, out=n)
        np.tanh(n, out=n)
        new = states[t]
        np.subtract(h, n, out=new)
        np.multiply(new, z, out=new)
        np.add(new, n, out=new)  # n + z (h - n)
        if tape is not None:
            tape.append((t, h, r, z, n))
        h = new
    return states


def position_probabilities(model: Model, codes: np.ndarray) -> np.ndarray:
    """Softmax over languages for every position: (T, B, C)."""
    p = model.params
    logits = run_direction(p, "f", codes) @ p["of"]
    logits += run_direction(p, "b", codes) @ p["ob"]
    logits += p["bias"]
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def gradients(model: Model, codes: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over unmasked positions and its gradient, by backpropagation through time."""
    p = model.params
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    tapes: dict[str, list] = {"f": [], "b": []}
    states = {d: run_direction(p, d, codes, tapes[d]) for d in "fb"}
    logits = states["f"] @ p["of"] + states["b"] @ p["ob"] + p["bias"]
    logits -= logits.max(axis=-1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=-1, keepdims=True)
    total = max(float(mask.sum()), 1.0)
    chosen = np.take_along_axis(prob, np.broadcast_to(labels[None, :, None], (*codes.shape, 1)), axis=2)[..., 0]
    loss = float(-(np.log(chosen + 1e-9) * mask).sum() / total)
    d_logits = prob
    d_logits[np.arange(codes.shape[0])[:, None], np.arange(codes.shape[1])[None, :], labels[None, :]] -= 1
    d_logits *= (mask / total)[..., None]
    flat = d_logits.reshape(-1, d_logits.shape[-1])
    grads["bias"] = flat.sum(axis=0)
    order = np.argsort(codes, axis=None, kind="stable")
    present, runs = np.unique(codes.ravel()[order], return_index=True)
    for d in "fb":
        grads[f"o{d}"] = states[d].reshape(-1, HIDDEN).T @ flat
        d_states = d_logits @ p[f"o{d}"].T
        carry = np.zeros_like(d_states[0])
        pushed = np.empty((*codes.shape, 3, HIDDEN), d_states.dtype)
        for t, h, r, z, n in reversed(tapes[d]):
            dh = d_states[t] + carry
            dz = dh * (h - n) * z * (1 - z)
            dn = dh * (1 - z) * (1 - n * n)
            d_rh = dn @ p[f"un{d}"].T
            dr = d_rh * h * r * (1 - r)
            carry = dh * z + d_rh * r + dz @ p[f"uz{d}"].T + dr @ p[f"ur{d}"].T
            grads[f"un{d}"] += (r * h).T @ dn
            grads[f"uz{d}"] += h.T @ dz
            grads[f"ur{d}"] += h.T @ dr
            pushed[t, :, 0], pushed[t, :, 1], pushed[t, :, 2] = dr, dz, dn
        by_byte = np.add.reduceat(pushed.reshape(len(order), -1)[order], runs, axis=0)
        for i, g in enumerate("rzn"):
            grads[f"w{g}{d}"][present] = by_byte[:, i * HIDDEN : (i + 1) * HIDDEN]
    return loss, grads


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) codes with zero padding at the end, and the real length of each window."""
    count = -(-len(raw) // WINDOW)
    codes = np.zeros(count * WINDOW, np.uint8)
    codes[: len(raw)] = np.frombuffer(raw, np.uint8)
    lengths = np.full(count, WINDOW)
    if count:
        lengths[-1] = len(raw) - WINDOW * (count - 1)
    return codes.reshape(count, WINDOW), lengths


def train(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = 7) -> Model | None:
    """Fit on (text, language) pairs in ``steps`` batches, or more until every window had its turn; None without any."""
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return None
    model = init(languages, seed)
    rng = np.random.default_rng(seed)
    codes, lengths, labels = [], [], []
    for text, lang in sorted(samples):
        c, n = windows(text.encode("utf-8", "replace"))
        codes.append(c)
        lengths.append(n)
        labels.append(np.full(len(c), languages.index(lang)))
    all_codes, all_lengths, all_labels = np.concatenate(codes), np.concatenate(lengths), np.concatenate(labels)
    if not len(all_codes):
        return None
    by_label = [np.flatnonzero(all_labels == c) for c in range(len(languages))]
    by_label = [rng.permutation(x) for x in by_label if len(x)]
    # Languages weigh alike in a batch; one with fewer windows comes round again.
    each = max(1, BATCH // len(by_label))
    steps = max(steps, -(-max(map(len, by_label)) // each))
    first = {k: np.zeros_like(v) for k, v in model.params.items()}
    second = {k: np.zeros_like(v) for k, v in model.params.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([x.take(np.arange((step - 1) * each, step * each), mode="wrap") for x in by_label])
        at = all_codes[pick].T.astype(np.intp)
        mask = (np.arange(WINDOW)[:, None] < all_lengths[pick][None, :]).astype(np.float32)
        _, grads = gradients(model, at, mask, all_labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.params[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def classify(model: Model | None, texts: list[str | None], block: int = 2048) -> tuple[list[str], list[float]]:
    """Language and pooled probability of each whole text."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    sums = np.zeros((len(texts), len(model.languages)))
    counts = np.zeros(len(texts))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        nonlocal held, waiting
        if not held:
            return
        codes = np.concatenate([c for c, _, _ in held])
        lengths = np.concatenate([n for _, n, _ in held])
        owners = np.concatenate([o for _, _, o in held])
        for lo in range(0, len(codes), block):
            c, n, o = codes[lo : lo + block], lengths[lo : lo + block], owners[lo : lo + block]
            prob = position_probabilities(model, np.ascontiguousarray(c.T).astype(np.intp))
            prob *= (np.arange(WINDOW)[:, None] < n[None, :])[..., None]
            pooled = prob.sum(axis=0)
            for k in range(pooled.shape[1]):
                sums[:, k] += np.bincount(o, pooled[:, k], len(texts))
            np.add.at(counts, o, n)
        held, waiting = [], 0

    for i, text in enumerate(texts):
        if text is None or not has_letter(text):
            continue
        c, n = windows(text.encode("utf-8", "replace"))
        held.append((c, n, np.full(len(c), i)))
        waiting += len(c)
        if waiting >= 2 * block:
            flush()
    flush()
    for i in np.flatnonzero(counts):
        mean = sums[i] / counts[i]
        best = int(mean.argmax())
        langs[i], scores[i] = model.languages[best], float(min(1.0, max(0.0, mean[best])))
    return langs, scores


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = MOST_LANGUAGES) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts a language outside the held-out fold, chosen by a hash of the id.

    A threshold from a language's number of distinct ids (a sketch, within some per cent)
    lets about four times as many ids through, as hashes; of these the smallest are taken, and
    one text for each. Copies of an id meet before the shuffle, so no task gathers a language.
    """
    h = F.xxhash64("doc_id").alias("h")
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (common.fold("doc_id", 4) != 2)).select("lang", h, "text")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("count")).orderBy(F.desc("count"), "lang").limit(languages)
    half = float(1 << 63)
    upto = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("count")).alias("upto")
    may = labelled.drop("text").join(F.broadcast(counts.select("lang", upto)), "lang").where(F.col("h").cast("double") < (F.col("upto") * 2 - 1) * F.lit(half))
    smallest = F.slice(F.sort_array(F.collect_set("h")), 1, per_language)
    chosen = may.distinct().groupBy("lang").agg(smallest.alias("hs")).select("lang", F.explode("hs").alias("h"))
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    rows = labelled.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(one).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"])) if has_letter(r["text"])]


def fit(docs: DataFrame) -> Model | None:
    """The network of a bounded sample, trained on the driver, which then gives its memory back."""
    model = train(training_sample(docs))
    common.give_back()
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` (all columns) with ``lang_pred`` and ``score`` added."""
    common.ship(docs.sparkSession)
    texts = [f for f in docs.schema.fields]
    lang_name, score_name = common.free_name(docs, "lang_pred"), common.free_name(docs, "score")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in texts] + [f"{lang_name} string", f"{score_name} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, SLICE_BYTES):
                langs, scores = classify(model, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang_name, score_name])

    return docs.mapInArrow(common.tidy(run), schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    model = fit(docs)
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (common.fold("doc_id", 4) == 2).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")

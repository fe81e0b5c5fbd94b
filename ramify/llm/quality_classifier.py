"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Features are hashed indicators: byte trigrams, words, and bins of how far a text repeats its words and word 5-grams.
Class log-count ratios come from all labelled training rows (one fixed-size table of counts). Indicators scaled by
these ratios, with unit length, feed a linear hinge-loss model that dual coordinate descent fits on a bounded sample
of the training rows (`sample`); a further part of it fits the logistic curve from margin to score.

Rows with crc32(id as text) mod `folds` = `held` are never learnt from. Inputs of a score are the text alone.

Defined results: null and empty texts have only the bin features, and get a score; a null id counts as the text ''
in the fold; a document that several label rows name has the largest label; repeated rows are each scored; an empty
table gives an empty result; with labels of one class or none, every score is that class's share, or 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_arrow, shingles_of, text_slices, texts_of, words_of

BITS = 18
SIZE = 1 << BITS
BINS = 16
#: Bytes of texts whose features are found at once: a few dozen times as many are held for them.
AT_ONCE = 1 << 18


def features(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text as (text index, feature), sorted by both."""
    keys = []
    lengths = np.diff(offsets)
    if len(data) >= 3:
        b = data.astype(np.uint32)
        gram = (((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(7)) & np.uint32(SIZE - 1)
        doc = np.repeat(np.arange(n), lengths)
        inside = doc[:-2] == doc[2:]  # a trigram ends in the text it begins in
        keys.append((doc[:-2][inside] << BITS) | gram[inside])
    hashes, owner, _, _ = words_of(data, offsets, lower=False)
    owner = owner.astype(np.int64)
    keys.append((owner << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
    # bins: shares of words equal to the one before, and of word 5-grams that are repeats
    words = np.bincount(owner, minlength=n)
    again = np.bincount(owner[1:], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]), minlength=n) if len(owner) > 1 else np.zeros(n)
    _, shingle_owner = shingles_of(hashes, owner, n)
    distinct = np.bincount(shingle_owner, minlength=n)
    windows = np.maximum(words - 4, 1)
    for k, share in enumerate((again / np.maximum(words, 1), 1 - distinct / windows)):
        level = np.ceil(np.clip(share, 0, 1) * (BINS - 1)).astype(np.int64)
        # all bins up to the level: a text that repeats much also repeats a little
        for i in range(BINS):
            on = np.flatnonzero(level >= i)
            keys.append((on << BITS) | (SIZE - 1 - k * BINS - i))
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key >> BITS, key & (SIZE - 1)


def _learn(share: float):
    """Counts of features by class over all rows, and the features of the rows whose hash is in the first `share` of all hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE), np.int64)
        seen = False
        for batch in batches:
            for part, data, offsets in text_slices(batch, most=AT_ONCE):
                seen = True
                y, h = part.column(2).to_numpy(), part.column(3).to_numpy()
                doc, feature = features(data, offsets, part.num_rows)
                for c in (0, 1):
                    counts[c] += np.bincount(feature[y[doc] == c], minlength=SIZE)
                kept = np.flatnonzero(h < share * 2.0**63)
                if len(kept):
                    lo, hi = np.searchsorted(doc, kept), np.searchsorted(doc, kept, "right")
                    rows = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(lo, hi, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(y[kept].astype(np.int32) + 1), pa.array(h[kept]), pa.array(rows, pa.binary())], ["kind", "key", "data"])
        if seen:
            parts = counts.reshape(2 * 64, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(128, np.int32)), pa.array(np.arange(128)), pa.array([zlib.compress(p.astype(np.uint32).tobytes(), 1) for p in parts], pa.binary())], ["kind", "key", "data"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64)
            sums[key] = sums[key] + got if key in sums else got
    for key, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tobytes()], pa.binary())], ["key", "data"])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 15, seed: int = 0) -> np.ndarray:
    """Weights w of min 1/2 |w|^2 + sum cost_i max(0, 1 - y_i w.x_i), where x_i is scale at the row's features, of unit length."""
    rng = np.random.default_rng(seed)
    values = [scale[r] / max(np.linalg.norm(scale[r]), 1e-12) for r in rows]
    alpha, w = np.zeros(len(rows)), np.zeros(len(scale))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, x = rows[i], values[i]
            gradient = y[i] * (w[r] @ x) - 1
            new = min(max(alpha[i] - gradient, 0.0), cost[i])  # x has unit length
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * y[i] * x
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit_logistic(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a margin + b))) by Newton's method, with the targets smoothed by one row of each class."""
    n1 = y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    x = np.stack([margin, np.ones(len(y))], 1)
    t = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * t)
        t += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def fit(docs: DataFrame, labels: DataFrame, *, folds: int, held: int, sample: int, sample_bytes: int) -> dict:
    """The model from rows outside the held fold. docs: id, text; labels: id, label."""
    scratch = Scratch(docs.sparkSession)
    train = labels.where("label IN (0, 1)").groupBy("id").agg(F.max("label").cast("long").alias("label"))
    train = train.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) != held)
    train = scratch.write(train.select("id", "label", F.expr("xxhash64(id, 11) & 9223372036854775807").alias("h")), "labels")
    total = train.count()
    share = 1.0 if total <= sample else sample / total
    joined = texts_of(docs, train).select("id", "text", "label", "h")
    learnt = scratch.write(joined.mapInArrow(_learn(share), "kind int, key long, data binary"), "learnt")
    counts = np.zeros((128, SIZE // 64), np.float64)
    for r in learnt.where("kind = 0").select("key", "data").repartition("key").mapInArrow(_sum, "key long, data binary").collect():
        counts[r["key"]] = np.frombuffer(r["data"], np.int64)
    counts = counts.reshape(2, SIZE)
    # rows of very many features count for several: what comes to the driver is bounded in bytes, too
    n_bytes = learnt.where("kind > 0").agg(F.sum(F.length("data").cast("long"))).first()[0] or 0
    most = 2.0**63 * share * min(1.0, sample_bytes / max(n_bytes, 1))
    got = sorted((r["key"], r["kind"] - 1, bytes(r["data"])) for r in learnt.where(F.col("kind") > 0).where(F.col("key") < F.lit(most)).collect())
    y = np.array([g[1] for g in got], np.int64)
    if len(set(y.tolist())) < 2:
        return {"weights": np.zeros(SIZE, np.float32), "scale": np.zeros(SIZE, np.float32), "curve": (0.0, {0: -3.0, 1: 3.0}.get(int(y[0]), 0.0) if len(y) else 0.0)}
    rows = [np.frombuffer(g[2], np.int32) for g in got]
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(counts[0] + counts[1]) < 3] = 0  # seen too rarely to say anything
    part = np.arange(len(rows)) % 4 == 3  # for the curve
    if len(set(y[~part].tolist())) < 2 or len(set(y[part].tolist())) < 2:
        part[:] = False
    fit_rows = [r for r, other in zip(rows, part, strict=True) if not other]
    fy = y[~part]
    balance = np.where(fy == 1, len(fy) / (2 * max(fy.sum(), 1)), len(fy) / (2 * max((1 - fy).sum(), 1)))
    w = dual_coordinate_descent(fit_rows, 2 * fy - 1, ratio, balance)
    model = {"weights": w.astype(np.float32), "scale": ratio.astype(np.float32), "curve": (1.0, 0.0)}
    use = part if part.any() else np.ones(len(y), bool)
    flat = [r for r, k in zip(rows, use, strict=True) if k]
    m = margins(model, np.repeat(np.arange(len(flat)), [len(r) for r in flat]), np.concatenate(flat), len(flat))
    model["curve"] = fit_logistic(m, y[use])
    return model


def margins(model: dict, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    x = model["scale"][feature].astype(np.float64)
    dot = np.bincount(doc, x * model["weights"][feature], minlength=n)
    return dot / np.maximum(np.sqrt(np.bincount(doc, x * x, minlength=n)), 1e-12)


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = model["curve"]
        for batch in batches:
            for part, data, offsets in text_slices(batch, most=AT_ONCE):
                doc, feature = features(data, offsets, part.num_rows)
                z = a * margins(model, doc, feature, part.num_rows) + b
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["id", "score"])

    return run


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, sample: int = 6000, sample_bytes: int = 64 << 20, cutoff: float = 0.7
) -> DataFrame:
    """id_col, held_out boolean, score double, predicted int. sample, sample_bytes: about how many training rows, and bytes of their features, the hinge-loss model is fitted on at most."""
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = fit(rows.where("id IS NOT NULL"), labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")), folds=folds, held=held, sample=sample, sample_bytes=sample_bytes)
    out = rows.mapInArrow(_score(model), "id long, score double")
    fold = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    return out.select(F.col("id").alias(id_col), (fold == held).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))

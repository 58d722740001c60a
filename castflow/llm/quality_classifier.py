"""Quality classifier: logistic regression over hashed word n-grams, fitted by FTRL-proximal updates.

Tokens are runs of letters, of digits or of other marks, with their case.  A text's features are its distinct
n-grams of 1 to ``ngrams`` tokens, hashed to ``bits`` bits, with equal weights of length 1.  Labels, ids, sources and languages are no
features.  The fit reads at most ``max_rows`` labelled rows of at most ``max_features`` features together, taken by a hash of their id;
scoring is one sparse dot product for each text, over the whole of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castflow.llm import common as C

#: Bounds on the labelled rows that the fit reads and on their features, 4 bytes each, which are all that the driver holds of the corpus.
MAX_ROWS, MAX_FEATURES = 6000, 1 << 25
BITS, NGRAMS = 18, 2
#: Bytes that begin a new token where they change: letters (with all of UTF-8's longer characters), digits, white space, others.
_KIND = np.full(256, 3, np.uint8)
_KIND[list(C.SPACES)] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = _KIND[data]
    if not len(kind):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    edges = offsets[1:-1]
    new[edges[edges < len(kind)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(kind))
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    return C.hash_spans(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, ngrams: int = NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row), sorted by row, each feature once a row."""
    n = len(offsets) - 1
    hashes, rows = _tokens(data, offsets)
    found, of = [], []
    for k in range(1, ngrams + 1):
        if len(hashes) < k:
            break
        total = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            total += hashes[j : len(hashes) - k + 1 + j] * C.salt(40 + j)
        whole = rows[: len(total)] == rows[k - 1 :]
        found.append((C.mix(total + C.salt(50 + k)) >> np.uint64(64 - bits))[whole])
        of.append(rows[: len(total)][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique((np.concatenate(of).astype(np.uint64) << np.uint64(bits)) | np.concatenate(found))
    assert n < 1 << (63 - bits)
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), (both >> np.uint64(bits)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 20.0, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.0, epochs: int = 6) -> tuple[np.ndarray, float]:
    """(weights, bias) after passes of per-coordinate FTRL-proximal steps over the rows in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weight(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            scale = 1 / np.sqrt(max(len(at), 1))
            w = weight(z[at], n[at])
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() * scale + b, -35, 35)))
            g = (p - y) * scale
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            gb = p - y
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * b
            nb += gb * gb
    return weight(z, n), float(-zb / ((beta + np.sqrt(nb)) / alpha))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, float]:
    """(weights, bias) from docs(doc_id, text) with a label of 0 or 1 in labels(doc_id, label).

    Null labels and ids are left out; of an id's labels the largest counts, of its texts the least.  Rows are read in the order of their
    ids' hashes, as far as their features are max_features together.  No labelled row at all gives weights of 0.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batch):
        data, offsets = C.texts_of(batch.column("text"))
        for row, end, some, at in C.chunks(data, offsets):
            found, of = features(some, at)
            yield pa.record_batch([batch.column("doc_id")[row:end], batch.column("y")[row:end], C.lists(found.astype(np.int32), np.bincount(of, minlength=end - row))], ["doc_id", "y", "features"])

    with C.Scratch(docs.sparkSession) as held:
        found = held.save(C.per_batch(rows, run, "doc_id long, y int, features array<int>"), "features")
        # at most max_rows rows of two numbers come here
        used = F.sum(F.col("n") + 1).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
        fits = found.select("doc_id", F.size("features").alias("n")).withColumn("used", used).where(F.col("used") <= max_features).select("doc_id")
        got = found.join(F.broadcast(fits), "doc_id").toArrow()
    if not got.num_rows:
        return np.zeros(1 << BITS), 0.0
    ids = got.column("doc_id").to_numpy()
    order = np.lexsort((ids, C.mix(ids.view(np.uint64))))
    column = got.column("features").combine_chunks()
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return ftrl([flat[at[i] : at[i + 1]] for i in order.tolist()], got.column("y").to_numpy()[order])


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text); null and empty texts get the score of the bias alone."""
    weights = weights.astype(np.float32)

    def run(batch):
        data, offsets = C.texts_of(batch.column("text"))
        for row, end, some, at in C.chunks(data, offsets):
            found, of = features(some, at)
            n = np.bincount(of, minlength=end - row)
            total = np.bincount(of, weights=weights[found], minlength=end - row) / np.sqrt(np.maximum(n, 1)) + bias
            yield pa.record_batch([batch.column("doc_id")[row:end], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    return C.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")

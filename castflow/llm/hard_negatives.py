"""Hard negatives by a threshold join in the manner of L2AP: an index without what suffix norms cover, and thresholds that fall until all windows are full.

Dimensions are ordered by their energy in the whole table.  Each task cuts its rows into blocks and indexes a block by dimension: the rows of
a dimension are those whose norm from there on is above a share of their whole norm; what comes later in a row is omitted from the index and kept
aside with its norm.  A block of anchors adds up its scores along the index, some dimensions at a time.  By Cauchy and Schwarz what is left of
two vectors can add no more than the product of the norms that remain, so rows that no anchor can reach any more leave the block; of
the others only pairs whose sum and bound reach the anchor's threshold get their omitted dimensions added.

Each anchor asks first with a high threshold and, while one of its windows is not full, again with a lower one; the last lets all
rows in that the window admits.  A task keeps only the best of a window, so what leaves it is bounded by windows and their size.  Anchors go in
blocks, each of which is sent to the tasks whole and bounded by ``ANCHORS`` and ``VALUES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castflow.functions.storage import scratch
from castflow.llm import common as C

#: Most anchors of a block, and most values of their vectors.
ANCHORS, VALUES = 1 << 15, 1 << 21
#: Rows of an index block, and anchors that meet it at once.
ROWS, TOGETHER = 2048, 1024
#: Dimensions that are added up between two looks at the bounds.
STEP = 16
#: The share of a row's norm under which the rest of its dimensions is omitted from the index.
OMITTED = 0.35
#: Thresholds of the search for positives, as shares of the highest score that norms allow; at last all rows count.
FALLING = (0.6, 0.4, 0.25, 0.12, None)
#: Thresholds of the search for negatives, as shares of the way from a window's upper end to its lower one.
OPENING = (0.12, 0.35, 1.0)

FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector) of rows(vec_id, label, vector), with floor(scale * component) in place of each component.

    Rows with a null id, label, vector or component or a component that isn't finite take no part, nor do rows whose scores a long may
    not hold (a squared norm of 2^62 and more after that).
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(F.col("vector").cast("array<double>"), lambda x: scale * x).alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x).cast("double"), F.lit(2.0)))
    whole = rows.where("vec_id is not null and label is not null and vector is not null").where(good).where(squares < 2.0**62)
    return whole.withColumn("vector", F.transform("vector", lambda x: F.floor(x)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows of a matrix; shorter ones end with zeros."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), dims), np.int64)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), inside] = flat[offsets[0] : offsets[-1]]
    return out


def statistics(vectors: DataFrame) -> tuple[np.ndarray, float]:
    """(dimensions by falling energy, greatest norm) of all vectors; one row for each dimension is gathered."""

    def run(batches):
        energy, most = np.zeros(0), -1.0
        for batch in batches:
            column = batch.column("vector")
            if batch.num_rows:
                squares = _matrix(column, int(np.diff(column.offsets.to_numpy()).max())).astype(np.float64) ** 2
                energy = np.pad(energy, (0, max(0, squares.shape[1] - len(energy))))
                energy[: squares.shape[1]] += squares.sum(axis=0)
                most = max(most, float(squares.sum(axis=1).max()))
        yield pa.record_batch([pa.array(np.arange(-1, len(energy))), pa.array(np.append(most, energy))], ["dim", "energy"])

    per = vectors.select("vector").mapInArrow(run, "dim long, energy double").groupBy("dim").agg(F.sum("energy").alias("energy"), F.max("energy").alias("most"))
    found = {r.dim: r for r in per.collect()}
    most = found.pop(-1).most if -1 in found else -1.0
    energy = np.array([found[d].energy for d in range(len(found))])
    return np.argsort(-energy, kind="stable"), float(np.sqrt(most)) if most >= 0 else -1.0


def _left(matrix: np.ndarray) -> np.ndarray:
    """For each row the norm of what stands from each place on; a last column of zeros."""
    squares = np.cumsum(matrix.astype(np.float64)[:, ::-1] ** 2, axis=1)[:, ::-1]
    return np.sqrt(np.pad(squares, ((0, 0), (0, 1))))


@dataclass
class Anchors:
    """A block of anchors; vectors in the index's order of dimensions.  of, low, high: for each window its anchor and the scores that it admits."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    positives: np.ndarray
    scores: np.ndarray

    def part(self, windows: np.ndarray) -> Anchors:
        """The block with only these windows and the anchors that they need."""
        used, of = np.unique(self.of[windows], return_inverse=True)
        return Anchors(self.ids[used], self.labels[used], self.vectors[used], of, *(x[windows] for x in (self.low, self.high, self.positives, self.scores)))


class Block:
    """An inverted index of some rows: by dimension the values of the rows that aren't omitted there, and what is omitted kept aside."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        left = _left(vectors)
        held = (left[:, :-1] > OMITTED * left[:, :1]).sum(axis=1)
        order = np.argsort(-held, kind="stable")  # the rows of a dimension are then the first ones
        self.ids, self.labels, self.left, self.held = ids[order], labels[order], left[order], held[order]
        dims, vectors = vectors.shape[1], vectors[order]
        indexed = np.arange(dims) < self.held[:, None]
        self.index, self.aside = np.where(indexed, vectors, 0).T, np.where(indexed, 0, vectors)
        self.rows_of = np.searchsorted(-self.held, -np.arange(dims), "left")
        self.omitted = np.take_along_axis(self.left, self.held[:, None], axis=1).ravel()

    def reached(self, vectors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose score is at least the anchor's threshold, and maybe of others that were near it."""
        dims, left = vectors.shape[1], _left(vectors)
        most = float(left[:, 0].max() * self.left[:, 0].max())
        kind = np.float64 if most < 2.0**53 else np.int64  # sums of products are exact
        x, index, aside = vectors.astype(kind), self.index.astype(kind), self.aside.astype(kind)
        floor = (least - 0.5 - 1e-9 * most)[:, None]
        rows = np.arange(len(self.ids))
        sums = np.zeros((len(x), len(rows)), kind)
        for at in range(0, dims, STEP):
            until = min(at + STEP, dims)
            n = int(np.searchsorted(rows, self.rows_of[at]))
            if not n:
                break
            sums[:, :n] += x[:, at:until] @ index[at:until, rows[:n]]
            if until == dims:
                break
            place = np.minimum(self.held[rows], until)  # what is omitted before counts as left
            alive = (sums + left[:, place] * self.left[rows, place] >= floor).any(axis=0)
            if alive.mean() < 0.75:
                rows, sums = rows[alive], sums[:, alive]
        i, j = np.nonzero(sums + left[:, self.held[rows]] * self.omitted[rows] >= floor)
        first = int(self.held.min()) if len(self.held) else 0
        if len(i) > sums.size // 16:
            score = (sums + x[:, first:] @ aside[rows, first:].T)[i, j]
        else:
            score = sums[i, j]
            for at in range(0, len(i), 1 << 15):
                some = slice(at, at + (1 << 15))
                score[some] += np.einsum("ij,ij->i", x[i[some], first:], aside[rows[j[some]], first:])
        return i, rows[j], score.astype(np.int64)


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The first k of each window by falling score, then id; found: windows, scores, ids."""
    window, score, ids = found
    order = np.lexsort((ids, -score, window))
    window = window[order]
    first = np.flatnonzero(np.diff(window, prepend=-1))
    rank = np.arange(len(window)) - np.repeat(first, np.diff(first, append=len(window)))
    return [x[order][rank < k] for x in found]


def asked(vectors: DataFrame, anchors: Anchors, dims: np.ndarray, least: np.ndarray, k: int, same: bool) -> DataFrame:
    """The first k rows of each window among those with the anchor's label (same) or another one that reach the window's threshold ``least``."""
    spare = 4 * k * len(anchors.of) + (1 << 20)
    of_anchor = np.full(len(anchors.ids), np.iinfo(np.int64).max)
    np.minimum.at(of_anchor, anchors.of, least)
    order = np.argsort(anchors.of, kind="stable")
    begin = np.searchsorted(anchors.of[order], np.arange(len(anchors.ids) + 1))

    def blocks(batch) -> Iterator[Block]:
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        for at in range(0, len(ids), ROWS):
            yield Block(ids[at : at + ROWS], labels[at : at + ROWS], _matrix(batch.column("vector").slice(at, ROWS), len(dims))[:, dims])

    def matches(block: Block) -> Iterator[list[np.ndarray]]:
        for at in range(0, len(anchors.ids), TOGETHER):
            i, j, score = block.reached(anchors.vectors[at : at + TOGETHER], of_anchor[at : at + TOGETHER])
            i = i + at
            ok = (anchors.labels[i] == block.labels[j]) == same
            ok &= anchors.ids[i] != block.ids[j]
            i, j, score = i[ok], j[ok], score[ok]
            for slot in range(int(np.diff(begin).max())):
                has = begin[i] + slot < begin[i + 1]
                window = order[(begin[i] + slot)[has]]
                fits = (score[has] >= np.maximum(least, anchors.low)[window]) & (score[has] <= anchors.high[window])
                yield [window[fits], score[has][fits], block.ids[j[has][fits]]]

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for block in blocks(batch):
                for more in matches(block):
                    held = [np.concatenate(x) for x in zip(held, more, strict=True)]
                    if len(held[0]) > spare:
                        held = _best(held, k)
        window, score, ids = _best(held, k)
        yield pa.record_batch([anchors.ids[anchors.of[window]], anchors.positives[window], anchors.scores[window], ids, score], [c.split()[0] for c in FOUND.split(", ")])

    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return vectors.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _full(found: DataFrame, anchors: Anchors, k: int) -> np.ndarray:
    """Whether each window has its k rows; one row of a full window is gathered."""
    full = found.where(F.col("rank") == k).select("anchor_id", "positive_id").toArrow()
    full = set(zip(full.column(0).to_pylist(), full.column(1).to_pylist(), strict=True))
    return np.array([x in full for x in zip(anchors.ids[anchors.of].tolist(), anchors.positives.tolist(), strict=True)], bool)


def positives(vectors: DataFrame, anchors: Anchors, dims: np.ndarray, most: float, k: int, held: C.Scratch) -> Anchors:
    """The anchors with a window for each of their k best rows of the same label (all, if fewer), open to all scores."""
    found, pending = [], np.arange(len(anchors.ids))
    norms = _left(anchors.vectors)[:, 0]
    for share in FALLING:
        now = anchors.part(pending)
        least = np.full(len(pending), np.iinfo(np.int64).min) if share is None else np.floor(share * most * norms[pending]).astype(np.int64)
        best = held.save(asked(vectors, now, dims, least, k, same=True), "positives")
        full = _full(best, now, k) if share is not None else np.ones(len(pending), bool)
        rows = best.select("anchor_id", "vec_id", "score").toArrow()
        done = np.isin(rows.column("anchor_id").to_numpy(), now.ids[full])
        found.append([rows.column(c).to_numpy()[done] for c in ("anchor_id", "vec_id", "score")])
        held.drop(best)
        pending = pending[~full]
        if not len(pending):
            break
    anchor, positive, score = (np.concatenate(x) for x in zip(*found, strict=True))
    at = np.argsort(anchors.ids)
    return replace(anchors, of=at[np.searchsorted(anchors.ids[at], anchor)], positives=positive, scores=score, low=np.full(len(score), np.iinfo(np.int64).min), high=np.full(len(score), np.iinfo(np.int64).max))


def hard_negatives(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows(vec_id, label, vector) on which ``anchor`` holds.

    Components count as floor(scale * component); a score is the inner product of two such vectors, the shorter ended with zeros.  An anchor's positives are its
    n_positives best other rows of its label, by falling score, then vec_id.  For each, the n_negatives best rows of other labels follow whose
    score is ``low`` to ``high`` per cent of the positive's, both included; so a positive with a negative score has none.  Rows with a null vec_id,
    label, vector or component or a component that isn't finite take no part, nor do rows too long for a score of 64 bits (``quantised``).  Rows that repeat a vec_id are one
    row, the least by label and vector.  No rows or no anchors: an empty result.  Other columns are not read.
    """
    spark = rows.sparkSession
    out = scratch(spark, "hard-negatives")
    result = "anchor_id long, positive_id long, positive_score long, vec_id long, score long, rank int"
    spark.createDataFrame([], result).write.parquet(f"{out}/round=0")
    number = 0
    with C.Scratch(spark) as held:
        vectors = held.save(quantised(rows, scale), "vectors")
        if not C.is_empty(vectors.groupBy("vec_id").count().where("count > 1")):
            once = held.save(vectors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector"), "vectors")
            held.drop(vectors)
            vectors = once
        dims, most = statistics(vectors)
        size = max(1, min(ANCHORS, VALUES // max(1, len(dims))))
        ranked = C.ranked(vectors.where(anchor).select("vec_id"), [], [F.col("vec_id")], held)
        blocks = held.save(ranked.select("vec_id", F.floor(F.col("rank") / size).alias("block")), "blocks")
        for block in range((blocks.agg(F.max("block")).first()[0] or 0) + 1 if not C.is_empty(blocks) else 0):
            got = vectors.join(blocks.where(F.col("block") == block).select("vec_id"), "vec_id").toArrow().combine_chunks()
            ids, labels = got.column("vec_id").to_numpy(), got.column("label").to_numpy()
            none = np.zeros(len(ids), np.int64)
            anchors = Anchors(ids, labels, _matrix(got.column("vector").combine_chunks(), len(dims))[:, dims], np.arange(len(ids)), none + np.iinfo(np.int64).min, none + np.iinfo(np.int64).max, none, none)
            windows = positives(vectors, anchors, dims, most, n_positives, held)
            # whole numbers with low * positive <= 100 * score <= high * positive
            lowest, highest = (np.array([f(s) for s in windows.scores.tolist()], np.int64) for f in (lambda s: -(-low * s // 100), lambda s: high * s // 100))
            windows = replace(windows, low=lowest, high=highest)
            pending = np.flatnonzero(lowest <= highest)
            for share in OPENING:
                if not len(pending):
                    break
                now, number = windows.part(pending), number + 1
                least = now.low if share == 1 else np.maximum(now.low, np.floor(now.high - share * (now.high - now.low)).astype(np.int64))
                best = held.save(asked(vectors, now, dims, least, n_negatives, same=False), "negatives")
                full = _full(best, now, n_negatives) if share < 1 else np.ones(len(pending), bool)
                done = [(int(a), int(p)) for a, p in zip(now.ids[now.of][full], now.positives[full], strict=True)]
                kept = best.join(F.broadcast(spark.createDataFrame(done, "anchor_id long, positive_id long")), ["anchor_id", "positive_id"], "left_semi") if not full.all() else best
                kept.select(*[c.split()[0] for c in result.split(", ")]).write.parquet(f"{out}/round={number}")
                held.drop(best)
                pending = pending[~full]
    found = spark.read.schema(result).parquet(*[f"{out}/round={i}" for i in range(number + 1)])
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

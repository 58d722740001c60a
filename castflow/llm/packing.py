"""Harmonic packing of token sequences.

Lengths are put into reciprocal-capacity classes: class j holds the pieces longer than capacity // (j + 1) and at
most capacity // j, and each of its bins takes j pieces, so every worker fills bins without knowing the others'
lengths.  A document is cut into full sequences first.  Its rest is cut at the class borders: while the rest would leave
more than ``max_waste`` of its slot unused, a piece that fills a slot of the next class exactly is cut off.  Bins
are numbered by gapless ranks within each class; only one count for each class and part is gathered.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castflow.llm import common as C
from castflow.llm.token_ids import encoder, with_end

PIECES = "part int, place long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int"


def cuts(capacity: int, max_waste: float) -> list[list[int]]:
    """For each rest below the capacity, the lengths of its pieces in order."""
    out: list[list[int]] = [[]]
    for rest in range(1, capacity):
        slot = capacity // (capacity // rest)
        next_slot = capacity // (capacity // rest + 1)
        # cut only where a rest remains and the slot that is cut out is not smaller than a few ids
        if slot - rest > max_waste * slot and 16 <= next_slot < rest:
            out.append([next_slot, *out[rest - next_slot]])
        else:
            out.append([rest])
    return out


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, max_waste: float, with_ids: bool) -> DataFrame:
    """PIECES of docs(doc_id, text), in the order of each task; with_ids adds the ids."""
    rests = cuts(capacity, max_waste)

    def run(batches):
        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = with_end(*encoder(vocabulary).encode(batch.column("text")), end_id)
            per = np.array([len(r) for r in rests])
            full, rest = counts // capacity, counts % capacity
            n = full + per[rest]
            lengths = np.full(int(n.sum()), capacity, np.int64)
            at = np.cumsum(n) - n + full
            for j in range(int(per.max())):
                has = per[rest] > j
                lengths[at[has] + j] = [rests[r][j] for r in rest[has].tolist()]
            row = np.repeat(np.arange(len(n)), n)
            ends = np.cumsum(lengths)
            before = np.cumsum(counts) - counts
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (b - x) : 4 * b]) for b, x in zip(ends.tolist(), lengths.tolist(), strict=True)]
            columns = [pa.array(np.full(len(row), part, np.int32)), pa.array(first + np.arange(len(row))), batch.column("doc_id").take(pa.array(row)), pa.array(ends - lengths - before[row]), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(counts[row]), pa.array((capacity // lengths).astype(np.int32))]
            names = ["part", "place", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
            yield pa.record_batch(columns + ([C.lists(ids.astype(np.int64), lengths)] if with_ids else []), names + (["ids"] if with_ids else []))
            first += len(row)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def harmonic(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, max_waste: float = 0.02, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class (and ids) for every piece of docs(doc_id, text).

    A null or empty text is its end id alone, so every row has at least one piece.  Rows that repeat a doc_id are
    packed each on its own.  Sequence ids are gapless from 0.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = C.save(pieces(docs, vocabulary, end_id, capacity, max_waste, with_ids), "pieces")
    # place within the class: pieces of the class in earlier parts, and earlier ones of the same part
    per = made.groupBy("class", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("class", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("part", "class").orderBy("place")
    placed = made.withColumn("nth", F.row_number().over(inside) - 1).join(per, ["part", "class"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    # full bins are numbered class by class; the last bins that the classes leave open share sequences after them
    total = made.groupBy("class").agg(F.count("*").alias("n"))
    open_bins = placed.join(F.broadcast(total), "class").where(F.col("rank") >= F.col("n") - F.col("n") % F.col("class")).groupBy("class", "n").agg(F.sum("length").alias("filled"))
    rows = [(c, n, f or 0) for c, n, f in total.join(open_bins, ["class", "n"], "left").orderBy("class").collect()]  # at most ``capacity`` rows
    places, first, shared = [], 0, []
    for c, n, _ in rows:
        places.append([c, n - n % c, first])
        first += n // c
    for i in sorted(range(len(rows)), key=lambda i: -rows[i][2]):
        filled = rows[i][2]
        k = next((k for k, used in enumerate(shared) if used + filled <= capacity), len(shared))
        if k == len(shared):
            shared.append(0)
        places[i] += [first + k, shared[k]]
        shared[k] += filled
    base = F.broadcast(made.sparkSession.createDataFrame(places, "class int, full long, base long, last long, shift long"))
    placed = placed.join(base, "class")
    closed = F.col("rank") < F.col("full")
    placed = placed.withColumn("sequence_id", F.when(closed, F.col("base") + F.floor(F.col("rank") / F.col("class"))).otherwise(F.col("last")).cast("long"))
    placed = placed.withColumn("slot", F.when(closed, F.col("rank") % F.col("class")).otherwise(F.col("shift") * capacity + F.col("rank") - F.col("full")))
    running = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(running), F.lit(0)).cast("long"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class", *(["ids"] if with_ids else []))

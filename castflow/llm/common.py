"""What the operators share: scratch tables, vectorised words and hashes, graph links, global ranks.

Rows of a table are only ever held a batch at a time.  Tables that are read more than once are
written to the shared folder that ``spark.checkpoint.dir`` names, so a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from castflow.functions.storage import scratch

#: ASCII white space that separates words: blank and \t \n \v \f \r.
SPACES = (9, 10, 11, 12, 13, 32)
#: Text handled at once inside a task; a longer document is a piece of its own.
CHUNK_BYTES = 1 << 20


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and returns it as read back: lineage ends here."""
    return _saved(df, scratch(df.sparkSession, name))


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in the shared folder; what is not needed any more is emptied, the rest at the end of a with block.

    A DataFrame that still reads a table must be written before the table is dropped.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._held = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[table for _, table in self._held.values()])

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        out = _saved(df, path)
        self._held[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            path, _ = self._held.pop(id(table), (None, None))
            if path:
                self.spark.range(0).write.mode("overwrite").parquet(path)  # the public way to delete a table's files


@contextmanager
def pruned_by_filter(spark: SparkSession) -> Iterator[None]:
    """Within, joins with a written table that has a condition on it send Spark's own Bloom filter (4 MB) to the other side's scan.

    Spark decides so by itself for scans of 10 GB and more; below, a semi-join would shuffle all texts to keep a few.
    """
    name = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {name + "enabled": "true", name + "applicationSideScanSizeThreshold": "0", name + "creationSideThreshold": "1GB", name + "expectedNumItems": "4000000", name + "numBits": str(1 << 25)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


# --- words and hashes, a batch at a time ---------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all 64 bits; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def salt(n: int) -> np.uint64:
    """The n-th fixed odd constant."""
    return mix(np.array([n], np.uint64) * _STEP + _STEP)[0] | np.uint64(1)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, _STEP | np.uint64(1))]))
    return _powers


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``most`` bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of bytes that are not separators; a run ends with its row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~separator[data]
    before = np.empty(len(word), bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(len(word), bool)
    after[-1], after[:-1] = False, word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(word))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def characters_alone(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the Han, Kana and Thai characters in UTF-8, each of which is a word of its own."""
    lead = np.flatnonzero((data == 0xE0) | ((data >= 0xE3) & (data <= 0xE9)) | (data == 0xF0))
    a, b = data[lead], data[np.minimum(lead + 1, len(data) - 1)] if len(lead) else data[lead]
    thai, kana, han = (a == 0xE0) & ((b == 0xB8) | (b == 0xB9)), (a == 0xE3) & (b >= 0x81) & (b <= 0x83), (a == 0xE3) & (b >= 0x90) | (a >= 0xE4) & (a <= 0xE9)
    more = (a == 0xF0) & (b >= 0xA0) & (b <= 0xAF)
    found = lead[thai | kana | han | more]
    return found, found + 3 + more[thai | kana | han | more]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """spans, with one for each Han, Kana and Thai character."""
    alone, until = characters_alone(data)
    if not len(alone):
        return spans(data, offsets, separator)
    rest = data.copy()
    for j in range(4):
        at = alone + j
        rest[at[at < until]] = 32
    starts, ends, _ = spans(rest, offsets, separator)
    starts, ends = np.concatenate([starts, alone]), np.concatenate([ends, until])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], np.searchsorted(offsets, starts[order], "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes in every task and run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int64)
    inside = at - np.repeat(first, lengths)
    values = _BYTE_CODES[data[inside + np.repeat(starts, lengths)]] * _power_table(int(lengths.max()))[inside]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _STEP)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def windows(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of k words of a row; of the whole row if it has fewer words, none if it has no words."""
    counts = np.bincount(rows, minlength=n_rows)
    if len(hashes) >= k:
        total = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            total += hashes[j : len(hashes) - k + 1 + j] * salt(j)
        whole = rows[: len(total)] == rows[k - 1 :]
        out, of = mix(total[whole]), rows[: len(total)][whole]
    else:
        out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = (counts > 0) & (counts < k)
    if short.any():
        first = np.cumsum(counts) - counts
        place = np.arange(len(hashes)) - first[rows]
        few = short[rows]
        weights = np.array([salt(j) for j in range(k)], np.uint64)
        parts = hashes[few] * weights[place[few]]
        of_few = np.flatnonzero(short)
        starts = np.cumsum(counts[of_few]) - counts[of_few]
        sums = np.add.reduceat(parts, starts) + counts[of_few].astype(np.uint64) * salt(99)
        out, of = np.concatenate([out, mix(sums)]), np.concatenate([of, of_few])
    return out, of


def distinct_in_rows(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by row and hash, each hash once a row."""
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order].astype(np.int32), kind="stable")]
    hashes, rows = hashes[order], rows[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[new], rows[new]
    return hashes, rows


class Often:
    """Counts 64-bit values a block at a time, and tells those that more than a share of the block's rows hold.

    A value above the share among all rows is above it in one block at least, so ``often`` finds it from what the blocks tell, with
    at most (values of a mean row) / share results; a value's count there is at most its true one.
    """

    SCHEMA = "value long, n long, rows long"
    #: Values that are counted together in a task.
    BLOCK = 1 << 22

    def __init__(self, share: float):
        self.share, self.held, self.rows = share, [], 0

    def add(self, values: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
        self.held.append(values)
        self.rows += rows
        if sum(map(len, self.held)) >= self.BLOCK:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        values, count = np.unique(np.concatenate(self.held), return_counts=True)
        often = count > max(1, self.share * self.rows)
        yield pa.record_batch([pa.array(np.append(values[often].view(np.int64), 0)), pa.array(np.append(count[often], 0)), pa.array(np.append(np.zeros(int(often.sum()), np.int64), self.rows))], ["value", "n", "rows"])
        self.held, self.rows = [], 0


def often(counted: DataFrame, share: float) -> np.ndarray:
    """The sorted values that blocks tell and whose counts come to more than the share of all rows."""
    total = counted.agg(F.sum("rows")).first()[0] or 0
    found = counted.where("n > 0").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") > max(1, share * total)).select("value")
    return np.sort(found.toArrow().column("value").to_numpy().view(np.uint64))


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches, each on its own."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column with so many values a row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


# --- graphs ------------------------------------------------------------------------------------


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable by the edges (a, b); ids without an edge are absent.  ``keep`` holds the table.

    Alternating large-star and small-star steps.  Only minima are aggregated and joined back, so no
    task ever gathers the neighbours of an id; each step's edges are written to the shared folder.
    """
    with Scratch(edges.sparkSession) as held:
        now = held.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

        def state(df: DataFrame):
            return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

        mark = state(now)
        while mark[0]:
            # stars around each id: its larger neighbours move to the least of the neighbourhood
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            # then each id and its smaller neighbours move to the least of these
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            before, now = now, held.save(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
            held.drop(before)
            seen = state(now)
            if seen == mark:
                break
            mark = seen
        return keep.save(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")


def link_cells(cells: DataFrame, keep: Scratch, measure: Callable[[DataFrame], DataFrame], central: str, admits: Callable[[str, str], Column], radius: float | None = None, closes: Callable[[DataFrame], DataFrame] = lambda open_: open_, more_pivots: int = 16) -> DataFrame:
    """Links (a, b) that connect all that is linked within any cell: connectivity is exact, not every link is listed.  ``keep`` holds the table.

    cells: (cell, id, ...), distinct; its other columns are properties of an id in a cell.  measure: pairs (a, b, ca, cb) to
    the same rows with ``dist`` and ``linked``; pairs it leaves out are not linked.  In each round a cell's most central members (the least
    by ``central``) are pivots; members not connected with a pivot yet are compared with it, if ``admits`` (exact
    bounds on the columns of both) allows a link.  A pivot has then met its whole cell and leaves it.  The nearest
    pivot is a member's region: where dist is a metric in which linked ids are at most the radius apart, members of one region are compared
    later only within the window | d(x, p) - d(y, p) | <= radius.  A cell goes on while it holds members of two
    components (and ``closes`` keeps them), with ``more_pivots`` times as many pivots, so a cell of n takes about log n rounds.
    Members that are known to be connected are never compared with one another, so groups of linked members make about a row a member.
    """
    more = [c for c in cells.columns if c not in ("cell", "id")]
    with Scratch(cells.sparkSession) as held:
        now = held.save(cells.withColumns({"c": F.col("id"), "near": F.lit(None).cast("long"), "gap": F.lit(None).cast("double")}), "cells")
        slots, links = 1, []
        while not is_empty(now):
            own = ["id", "c", "near", "gap", *more]
            lead = F.min(F.struct(F.col(central).alias("first"), *own)).alias("p")
            pivots = now.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(slots)).alias("slot")).agg(lead).select("cell", *[F.col(f"p.{c}").alias(f"p_{c}") for c in own])
            pivots = held.save(pivots, "pivots")
            window = (F.col("near") != F.col("p_near")) | (F.abs(F.col("gap") - F.col("p_gap")) <= (radius or 0) + 1e-9) if radius else F.lit(True)
            pairs = now.join(pivots, "cell").where((F.col("c") != F.col("p_c")) & admits("", "p_") & F.coalesce(window, F.lit(True)))
            swap = F.col("id") > F.col("p_id")
            sides = {"a": F.least("id", "p_id"), "b": F.greatest("id", "p_id"), "ca": F.when(swap, F.col("p_c")).otherwise(F.col("c")), "cb": F.when(swap, F.col("c")).otherwise(F.col("p_c"))}
            pairs = held.save(pairs.select("cell", "id", "p_id", *[x.alias(k) for k, x in sides.items()]), "pairs")
            asked = held.save(pairs.select("a", "b", "ca", "cb").distinct(), "asked")  # its size is known then: later rounds ask for few
            measured = held.save(measure(asked), "measured")
            found = measured.where("linked")
            label = hop = None
            if not is_empty(found):
                links.append(held.save(found.select("a", "b"), "links"))
                # two hops towards the least label: equal labels are connected, and that is all a round needs to know
                both = found.select(F.col("ca").alias("c"), F.col("cb").alias("to")).unionByName(found.select(F.col("cb").alias("c"), F.col("ca").alias("to")))
                hop = held.save(both.groupBy("c").agg(F.min("to").alias("to")).select("c", F.least("c", "to").alias("to")), "labels")
                label = hop.join(hop.select(F.col("c").alias("to"), F.col("to").alias("next")), "to", "left").select("c", F.coalesce("next", "to").alias("to"))
            left = now.join(pivots.select("cell", F.col("p_id").alias("id")), ["cell", "id"], "left_anti")
            if radius:
                dist = pairs.join(measured.where("dist is not null").select("a", "b", "dist"), ["a", "b"])
                nearest = dist.groupBy("cell", "id").agg(F.min(F.struct("dist", "p_id")).alias("_nearest"))
                left = left.join(nearest, ["cell", "id"], "left").withColumns({"near": F.coalesce("_nearest.p_id", "near"), "gap": F.coalesce("_nearest.dist", "gap")}).drop("_nearest")
            if label is not None:
                left = left.join(label, "c", "left").withColumn("c", F.coalesce("to", "c")).drop("to")
            left = held.save(closes(left.select(*now.columns)), "left")
            mixed = left.groupBy("cell").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("cell")
            before, now, slots = now, held.save(left.join(mixed, "cell", "left_semi"), "cells"), slots * more_pivots
            held.drop(before, pivots, pairs, asked, measured, left, hop)
        out = now.select(F.col("id").alias("a"), F.col("id").alias("b"))
        for one in links:
            out = out.unionByName(one)
        return keep.save(out, "links")


# --- ranks -------------------------------------------------------------------------------------


def ranked(df: DataFrame, keys: list[Column], order: list[Column], keep: Scratch, weight: str | None = None) -> DataFrame:
    """df with ``rank``, its gapless place from 0 within the keys, and with a weight the sum before it as ``before``.

    Rows are range-partitioned and sorted; only one count for each part and key is gathered by key.
    The sorted table is written first, so that places and counts come from the same rows; ``keep`` holds it.
    """
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))
    df = df.withColumn("_key", key)
    rows = df.repartitionByRange(*[F.col("_key"), *order]).sortWithinPartitions(F.col("_key"), *order)
    rows = keep.save(rows.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    amount = F.col(weight) if weight else F.lit(1)
    per = rows.groupBy("_key", "_part").agg(F.count("*").alias("_n"), F.sum(amount).cast("long").alias("_w"), F.min("_at").alias("_first"))
    w = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_key", "_part", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_w").over(w), F.lit(0)).alias("_sum"))
    out = rows.join(per, ["_key", "_part"]).withColumn("rank", F.col("_rows") + F.col("_at") - F.col("_first"))
    if weight:
        inside = Window.partitionBy("_key", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_sum") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return out.drop("_key", "_at", "_part", "_first", "_rows", "_sum")

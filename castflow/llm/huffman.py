"""Token ids as binary blocks: canonical, length-limited Huffman codes from counts over all documents.

Codes come from one count for each id of the vocabulary.  Documents are put in ascending doc_id order and cut
into blocks of whole documents; each block is one row of the written table, with its header (first place, documents
and lengths), the bit offset of every ``STRIDE``-th id, and its bits.  Any block can be decoded alone, and
in it any run between two checkpoints: the decoder walks all runs of a block side by side through one
table of 2 ** LIMIT entries.  The code book is a table beside the blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from castflow.llm import common as C
from castflow.llm.token_ids import encoder, with_end

#: The longest code in bits; enough for 65,536 different ids, and the decoder's table has 2 ** LIMIT entries.
LIMIT = 16
#: Ids between two checkpoints.
STRIDE = 512
#: Ids of a block, until its last document ends.
BLOCK_IDS = 1 << 17

IDS = "part int, start long, doc_id long, n long, ids binary"
BLOCKS = "part int, start long, n_ids long, doc_ids array<long>, lengths array<long>, checkpoints array<long>, bits binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than the limit; 0 for ids that don't occur (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} different ids need codes of more than {limit} bits")
    weight = np.sort(counts[used].astype(np.float64))
    n, row, kinds = len(used), weight, []
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        joined = np.concatenate([weight, pairs])
        order = np.argsort(joined, kind="stable")
        kinds.append(order < n)
        row = joined[order]
    # how many of the cheapest entries of each level are taken, from the last level down
    take, per = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(kinds):
        own = int(leaf[:take].sum())
        per[:own] += 1
        take = 2 * (take - own)
    per[:take] += 1
    lengths[used[np.argsort(counts[used], kind="stable")]] = per
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of the lengths: by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order]
        units = (np.uint64(1) << (np.uint64(LIMIT) - size.astype(np.uint64))).astype(np.uint64)
        codes[order] = (np.cumsum(units) - units) >> (np.uint64(LIMIT) - size.astype(np.uint64))
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every STRIDE-th id); the first bit is the highest of the first byte."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    total = int(size.sum())
    words = np.zeros(total // 64 + 2, np.uint64)
    word, room = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    fits = room >= 0
    inside = np.where(fits, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    new = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[new]] = np.bitwise_or.reduceat(inside, new)
    over = np.flatnonzero(~fits)
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], at[::STRIDE]


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for each value of the next LIMIT bits."""
    order = np.lexsort((codes, lengths))
    order = order[lengths[order] > 0]
    times = 1 << (LIMIT - lengths[order])
    ids, size = np.repeat(order, times), np.repeat(lengths[order], times)
    room = (1 << LIMIT) - len(ids)
    return np.append(ids, np.zeros(room, np.int64)).astype(np.uint32), np.append(size, np.ones(room, np.int64)).astype(np.int64)


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a block."""
    symbol, size = table
    data = np.frombuffer(bits + bytes(4), np.uint8).astype(np.uint32)
    if n == 0:
        return np.zeros(0, np.uint32)
    three = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    out = np.zeros((len(checkpoints), STRIDE), np.uint32)
    at, last = np.array(checkpoints, np.int64), len(three) - 1
    for j in range(min(STRIDE, n)):
        window = (three[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[:, j] = symbol[window]
        at += size[window]
    return out.reshape(-1)[:n]


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """IDS of docs(doc_id, text) as they lie: part is the Spark partition, start the ids before a document in it."""

    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = with_end(*encoder(vocabulary).encode(batch.column("text")), end_id)
            wide = np.dtype("<u2") if vocabulary_size(vocabulary) <= 1 << 16 and end_id < 1 << 16 else np.dtype("<u4")
            raw, ends = ids.astype(wide).tobytes(), np.cumsum(counts)
            at = (np.append(0, ends) * wide.itemsize).tolist()
            rows = [pa.array(np.full(len(counts), part, np.int32)), pa.array(start + ends - counts), batch.column("doc_id"), pa.array(counts), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())]
            yield pa.record_batch(rows, ["part", "start", "doc_id", "n", "ids"])
            start += len(ids)

    return docs.select("doc_id", "text").mapInArrow(run, IDS)


def vocabulary_size(vocabulary: str) -> int:
    return encoder(vocabulary).tokenizer.get_vocab_size(with_added_tokens=True)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, number of ids of each) of IDS rows."""
    counts = batch.column("n").to_numpy()
    raw = b"".join(batch.column("ids").to_pylist())
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * counts.sum() else "<u4").astype(np.uint32), counts


def count_ids(ids: DataFrame) -> DataFrame:
    """(id, n) over all documents; each task sends one row for each id that it has met."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                n = np.bincount(_flat(batch)[0])
                if len(n) > len(total):
                    total = np.append(total, np.zeros(len(n) - len(total), np.int64))
                total[: len(n)] += n
        some = np.flatnonzero(total)
        if len(some):
            yield pa.record_batch([pa.array(some), pa.array(total[some])], ["id", "n"])

    return ids.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def blocks(ids: DataFrame, lengths: np.ndarray) -> DataFrame:
    """BLOCKS of IDS rows: runs of documents that follow each other in a part, until a block has BLOCK_IDS ids."""
    codes = canonical(lengths)

    def one(rows):
        counts = np.array([r[2] for r in rows], np.int64)
        flat = np.concatenate([r[3] for r in rows])
        bits, checkpoints = pack(flat, lengths, codes)
        return pa.record_batch(
            [pa.array([rows[0][0][0]], pa.int32()), pa.array([rows[0][0][1]], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([checkpoints], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
            ["part", "start", "n_ids", "doc_ids", "lengths", "checkpoints", "bits"],
        )

    def run(batches):
        rows, size, follows = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, counts = _flat(batch)
            ends = np.cumsum(counts)
            for part, start, doc, n, end in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("doc_id").to_pylist(), counts.tolist(), ends.tolist(), strict=True):
                if rows and ((part, start) != follows or size >= BLOCK_IDS):
                    yield one(rows)
                    rows, size = [], 0
                rows.append(((part, start), doc, n, flat[end - n : end]))
                size, follows = size + n, (part, start + n)
        if rows:
            yield one(rows)

    return ids.mapInArrow(run, BLOCKS)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Writes docs(doc_id, text) to ``path``: blocks, parts (the ids before each part) and codes, as Parquet.

    Parts are ranges of doc_id in ascending order (null first), and documents ascend in a part.  A null text counts as
    empty: its end id alone.  Rows that repeat a doc_id are written one after the other.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with C.Scratch(spark) as held:
        # texts move once, before they are encoded; sampling for the ranges would encode them twice afterwards
        ids = held.save(encoded(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), vocabulary, end_id), "ids")
        counts = held.save(count_ids(ids), "id-counts").toPandas()  # at most one row for each id of the vocabulary
        total = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
        total[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
        lengths = code_lengths(total)
        some = np.flatnonzero(lengths)
        spark.createDataFrame(pa.table({"id": some, "length": lengths[some]})).coalesce(1).write.parquet(f"{path}/codes")
        blocks(ids, lengths).write.option("compression", "none").parquet(f"{path}/blocks")
        sizes = ids.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each part
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and with_ids the ids as an array) of every document that was written."""
    book = spark.read.parquet(f"{path}/codes").toPandas()  # at most one row for each id of the vocabulary
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.int64)
    lengths[book["id"].to_numpy(dtype=np.int64)] = book["length"].to_numpy(dtype=np.int64)

    def run(batches):
        table = decode_table(lengths, canonical(lengths))
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, n, bits = (batch.column(k)[i].as_py() for k in ("part", "start", "n_ids", "bits"))
                docs, counts, checkpoints = (batch.column(k)[i].values for k in ("doc_ids", "lengths", "checkpoints"))
                counts = counts.to_numpy(zero_copy_only=False)
                ids = unpack(bits, checkpoints.to_numpy(zero_copy_only=False), n, table)
                raw, at = ids.astype("<u4").tobytes(), np.append(0, np.cumsum(counts))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                rows = [pa.array(np.full(len(counts), part, np.int32)), docs, pa.array(start + at[:-1]), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.record_batch(rows + ([C.lists(ids.astype(np.int64), counts)] if with_ids else []), ["part", "doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else []))

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    docs = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, schema)
    return docs.join(spark.read.parquet(f"{path}/parts"), "part").withColumn("start", F.col("start") + F.col("part_start")).drop("part", "part_start")

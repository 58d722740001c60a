"""Near-duplicate documents by SimHash: all fingerprints of 64 bits within 3 bits, found through deletion variants.

Three differing bits over two halves leave at most one in some half.  Each distinct fingerprint therefore names a cell for each half as it
is, and one for each of its 32 bits as wildcard: the half without the bit.  Two fingerprints within the radius are equal in a half, or differ there in
one bit and share that bit's wildcard cell.  Only cells that can hold such a pair go on:

* in a small cell all pairs are verified, so its pairs are bounded by its size's bound;
* in a larger one the other halves are what may differ, by 3 bits in a cell of equal halves and by 2 in a wildcard cell.  Two values within 3 bits have a value
  between them within 1 of the one and 2 of the other, so each member names all values near its own, and those that meet at a
  value are linked: rows grow with the members, not with their pairs, and each place holds few members by construction.

Equal fingerprints are one member from the start.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castflow.llm import common as C

#: The most bits in which linked fingerprints differ.
RADIUS = 3
#: Cells of up to so many fingerprints are compared by pairs.
SMALL = 64
#: The seed of the shingles' hashes.
SEED = 42
_SHINGLES = 1 << 16


def _counts(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes of the spans of each row."""
    text, hashed = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    counts = np.zeros((n_rows, 64), np.int64)
    for at in range(0, len(starts), _SHINGLES):
        some = slice(at, at + _SHINGLES)
        of, first, n = np.unique(rows[some], return_index=True, return_counts=True)
        hashes = np.fromiter((hashed(text[a:b], SEED) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)), ">u8", int(n.sum()))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        for row, a, size in zip(of.tolist(), first.tolist(), n.tolist(), strict=True):
            counts[row] += bits[a : a + size].sum(axis=0, dtype=np.int64)
    return counts


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after another, each with a blank after it, and where each begins."""
    lengths = ends - starts + 1
    first = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    out = data[np.minimum(inside + np.repeat(starts, lengths), len(data) - 1)]
    out[first + lengths - 1] = 32
    return out, first


def _of_texts(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """The fingerprints of a chunk of texts, as unsigned 64-bit numbers."""
    n_rows, (starts, ends, rows) = len(offsets) - 1, C.spans(data, offsets)
    if not len(starts):
        return np.zeros(n_rows, np.uint64)
    joined, first = _joined(data, starts, ends)
    until = first + (ends - starts)
    held = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(held) - held
    place = np.arange(len(rows)) - begin[rows]
    last = np.minimum(place + words, held[rows]) - 1  # of a text of fewer words, the one shingle ends with the last
    use = (place + words <= held[rows]) | (place == 0)
    total = np.bincount(rows[use], minlength=n_rows)
    counts = _counts(joined, first[use], until[begin[rows] + last][use], rows[use], n_rows)
    bits = 2 * counts > total[:, None]
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, print): the SimHash of each text's shingles of lower-cased words, as a long with the same bits."""

    def run(batch):
        ids = batch.column("doc_id")
        data, offsets = C.texts_of(batch.column("text"))
        for row, end, some, at in C.chunks(data, offsets):
            yield pa.record_batch([ids[row:end], pa.array(_of_texts(C.lower_ascii(some), at, words).view(np.int64))], ["doc_id", "print"])

    return C.per_batch(docs.select("doc_id", "text"), run, "doc_id long, print long")


def _near(most: int) -> list[int]:
    """All 32-bit masks of at most so many bits, those of fewer bits first."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(32), k)]


_LOW = 0xFFFFFFFF


def _half(half: Column, print_: Column, other: bool = False) -> Column:
    """The half (0: low, 1: high) of a fingerprint, or its other one, as a number below 2^32."""
    high = (half == 0) if other else (half == 1)
    return F.when(high, F.shiftrightunsigned(print_, 32)).otherwise(print_.bitwiseAND(F.lit(_LOW)))


def cells(prints: DataFrame) -> DataFrame:
    """(half, bit, value, print): the cells of each fingerprint; bit -1 is the half as it is, else the half without the bit."""
    places = F.explode(F.array(*[F.struct(F.lit(h).cast("tinyint").alias("half"), F.lit(b).cast("tinyint").alias("bit"), F.lit(~(1 << b) & 0xFFFFFFFF if b >= 0 else 0xFFFFFFFF).cast("long").alias("mask")) for h in (0, 1) for b in range(-1, 32)]))
    rows = prints.select("print", places.alias("p")).select("print", "p.*")
    return rows.select("half", "bit", _half(F.col("half"), F.col("print")).bitwiseAND(F.col("mask")).alias("value"), "print")


def _set(bit: str = "bit") -> Column:
    """Whether the wildcard bit is set in the fingerprint; false in cells of equal halves."""
    return (F.col(bit) >= 0) & (F.expr(f"shiftrightunsigned(print, cast(greatest({bit}, 0) as int) + 32 * half) & 1") == 1)


def links(prints: DataFrame, held: C.Scratch, small: int = SMALL) -> DataFrame:
    """Links (a, b) of the distinct fingerprints that connect all that is within the radius; written."""
    key = ["half", "bit", "value"]
    placed = held.save(cells(prints).withColumn("on", _set()), "cells")
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n"), F.min("on").alias("lo"), F.max("on").alias("hi"))
    # members of a wildcard cell that agree in its bit share the cell of the half as it is
    sizes = held.save(sizes.where((F.col("n") > 1) & ((F.col("bit") < 0) | (F.col("lo") != F.col("hi")))).select(*key, "n"), "sizes")
    crowded = held.save(placed.join(sizes, key), "crowded")
    held.drop(placed)
    few, many = crowded.where(F.col("n") <= small), crowded.where(F.col("n") > small)

    one, two = few.select(*key, "on", F.col("print").alias("a")), few.select(*key, F.col("on").alias("on_b"), F.col("print").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = one.join(two, key).where((F.col("a") < F.col("b")) & ((F.col("bit") < 0) | (F.col("on") != F.col("on_b"))) & (apart <= RADIUS)).select("a", "b")

    # in a cell of equal halves a place links if a member is within 1 of it, as all others are within 2
    other = _half(F.col("half"), F.col("print"), other=True)
    masks = lambda most: F.array(*[F.lit(m).cast("long") for m in _near(most)])
    whole = many.where("bit < 0").select(*key, "print", other.alias("own"), F.posexplode(masks(2)).alias("place", "mask"))
    wild = many.where("bit >= 0").select(*key, "print", other.alias("own"), F.posexplode(masks(1)).alias("place", "mask"))
    met = whole.unionByName(wild).select(*key, F.col("own").bitwiseXOR(F.col("mask")).alias("at"), "print", (F.col("place") <= 32).alias("close"))
    met = held.save(met.repartition(*key, "at").groupBy(*key, "at").agg(F.collect_list("print").alias("prints"), F.max("close").alias("linked")).where(F.col("linked") & (F.size("prints") > 1)).select(F.array_min("prints").alias("a"), F.explode("prints").alias("b")).where("a <> b").distinct(), "met")
    out = held.save(pairs.unionByName(met).distinct(), "links")
    held.drop(sizes, crowded, met)
    return out


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, class_id, component_id) for every row of docs(doc_id, text).

    fingerprint: 16 hexadecimal digits.  class_id: the smallest doc_id with the same fingerprint.  component_id: the smallest doc_id reachable by links,
    where fingerprints link that differ in at most 3 bits.  A text of fewer words is one shingle; null and empty texts and texts without words have the
    fingerprint zero, which links like any other.  Rows that repeat a doc_id are one document: their fingerprints count as linked.
    A null doc_id gives null ids and links nothing.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with C.Scratch(docs.sparkSession) as held:
        prints = held.save(fingerprints(docs, words), "prints")
        real = prints.where("doc_id is not null")
        classes = held.save(real.groupBy("print").agg(F.min("doc_id").alias("class_id")), "classes")
        twice = real.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a < b").select("doc_id", "a")
        twice = real.join(twice, "doc_id").select("a", F.col("print").alias("b"))
        found = C.components(links(classes.select("print"), held).unionByName(twice), held).select(F.col("id").alias("print"), F.col("component").alias("of"))
        whole = classes.join(found, "print", "left").withColumn("of", F.coalesce("of", "print"))
        whole = whole.join(whole.groupBy("of").agg(F.min("class_id").alias("component_id")), "of").select("print", "class_id", "component_id")
        ids = prints.join(whole, "print", "left")
        named = [F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("class_id", "component_id")]
        return C.save(ids.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), *named), "simhash")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; other columns stay.  Rows without a doc_id stay."""
    out = near_duplicates(docs, words).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)

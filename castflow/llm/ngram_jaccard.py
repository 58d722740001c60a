"""N-gram Jaccard join: all documents whose sets of word n-grams are alike, by a metric-space join.

The Jaccard distance of two sets is a metric.  Over a corpus nearly every document is at distance 1 from
every pivot, so Voronoi regions of the whole corpus would prune nothing.  The space is therefore first cut by exact counting, and
the metric join runs inside what is left:

* equal sets are one class, named by a 64-bit fingerprint, so copies never meet each other;
* a set linked with another one holds at most (1 - threshold) of its n-grams alone.  Of a fixed share of all n-grams it
  is counted which two different sets hold; sets with more n-grams of their own are closed: mostly nine in ten;
* n-grams of the open sets are counted in full, and each set names a cell for each of its rarest n-grams that
  another one holds, as far as its prefix goes: of two linked sets the longest prefixes in one order of all n-grams meet.  A set's place of
  the n-gram bounds what two sets can share, so far members of a large group of near copies rarely meet;
* in each cell the members with fewest n-grams of their own are pivots.  Members are compared with them, the nearest one is a
  member's Voronoi region, and the rest is compared with further pivots only inside the triangle-inequality window, round by
  round until all members of a cell are connected or compared (``common.link_cells``).

Common n-grams (in more than a share of the documents) are known from a bounded list and come last in every order: no cell and no count has
a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castflow.llm import common as C


def most_changes(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """The most elements in which a set within the threshold num/den of a set of n can differ from it."""
    return n * (den - num) // num


def _sets(batch: pa.RecordBatch, words: int):
    """For chunks of the batch: row range, sorted distinct n-gram hashes and their row."""
    data, offsets = C.texts_of(batch.column("text"))
    for row, end, some, at in C.chunks(data, offsets):
        some = C.lower_ascii(some)
        starts, ends, rows = C.spans(some, at)
        hashes, of = C.windows(C.hash_spans(some, starts, ends), rows, end - row, words)
        yield row, end, *C.distinct_in_rows(hashes, of)


def _names(hashes: np.ndarray, n: np.ndarray, number: int) -> np.ndarray:
    """A fingerprint of each run of n hashes, whatever their order."""
    total, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(some):
        total[some] = np.add.reduceat(C.mix(hashes ^ C.salt(number)), (np.cumsum(n) - n)[some])
    return total


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2): the size of each document's set and 128 bits that name the set."""

    def run(batch):
        ids = batch.column("doc_id")
        for row, end, hashes, rows in _sets(batch, words):
            n = np.bincount(rows, minlength=end - row)
            prints = [_names(hashes, n, s).view(np.int64) for s in (11, 12)]
            yield pa.record_batch([ids[row:end], pa.array(n, pa.int64()), *map(pa.array, prints)], ["doc_id", "n_shingles", "f1", "f2"])

    return C.per_batch(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, f1 long, f2 long")


#: N-grams in more than this share of the documents count as common.
COMMON_SHARE = 1 / 4000
#: The share of all n-grams that are counted first, in times the share that a linked set can hold alone.
SAMPLED = 5 / 3


def common_grams(docs: DataFrame, words: int, scratch: C.Scratch, share: float = COMMON_SHARE) -> np.ndarray:
    """The sorted hashes of the n-grams that more than the share of the documents hold, at most (n-grams of a mean document) / share.

    They only order n-grams: links do not depend on them.
    """

    def run(batches):
        count = C.Often(share)
        for batch in batches:
            for row, end, hashes, _ in _sets(batch, words):
                yield from count.add(hashes, end - row)
        yield from count.rest()

    return C.often(scratch.save(docs.select("text").mapInArrow(run, C.Often.SCHEMA), "common"), share)


def _among(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(hashes), bool)
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def samples(docs: DataFrame, words: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """(set, need, grams): of each document's set the n-grams of the fixed share that are not common, and of how many of them another set must hold a copy, or the set is closed.

    Sets so small that no other set can be linked with them, and empty ones, are left out.
    """
    top = np.uint64(min(2**64 - 1, int(2**64 * SAMPLED * (den - num) / den)))

    def run(batch):
        for row, end, hashes, rows in _sets(batch, words):
            n = np.bincount(rows, minlength=end - row)
            names = _names(hashes, n, 11)
            use = (hashes <= top) & ~_among(hashes, common)
            count = np.bincount(rows[use], minlength=end - row)
            open_ = np.flatnonzero(most_changes(n, num, den) > 0)
            kept = use & (most_changes(n, num, den) > 0)[rows]
            need = count[open_] - n[open_] * (den - num) // den
            yield pa.record_batch([pa.array(names[open_].view(np.int64)), pa.array(need.astype(np.int32)), C.lists(hashes[kept].view(np.int64), count[open_])], ["set", "need", "grams"])

    return C.per_batch(docs.select("text"), run, "set long, need int, grams array<long>")


def sets(docs: DataFrame, words: int, common: np.ndarray) -> DataFrame:
    """(set, n, rare, grams): the hashed n-grams of each document's set, the ``rare`` first of which are not common."""

    def run(batch):
        for row, end, hashes, rows in _sets(batch, words):
            n = np.bincount(rows, minlength=end - row)
            often = _among(hashes, common)
            order = np.lexsort((hashes, often, rows))
            rare = np.bincount(rows[~often], minlength=end - row)
            yield pa.record_batch([pa.array(_names(hashes, n, 11).view(np.int64)), pa.array(n.astype(np.int32)), pa.array(rare.astype(np.int32)), C.lists(hashes[order].view(np.int64), n)], ["set", "n", "rare", "grams"])

    return C.per_batch(docs.select("text"), run, "set long, n int, rare int, grams array<long>")


def open_sets(sampled: DataFrame) -> DataFrame:
    """(set): those of the samples whose n-grams others hold often enough."""
    span = Window.partitionBy("gram")
    rows = sampled.where("need > 0").select(F.explode("grams").alias("gram"), "set").repartition("gram")
    shared = rows.select("gram", "set", F.min("set").over(span).alias("lo"), F.max("set").over(span).alias("hi")).where("lo < hi")
    shared = shared.select("gram", "set").distinct().groupBy("set").agg(F.count("*").alias("shared"))  # stays where the n-grams are
    needs = sampled.groupBy("set").agg(F.max("need").alias("need"))
    return needs.join(shared, "set", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("need")).select("set")


def cells(held: DataFrame, num: int, den: int) -> DataFrame:
    """(cell, id, n, pos): for each set its rarest n-grams that other sets of ``held`` hold, within its prefix.

    n-grams are ordered by the number of sets that hold them, then by hash, common ones last.  pos: how many of the set come before.  Two
    linked sets share one of the n - ceil(threshold * n) + 1 first of each.
    """
    prefix = F.col("n") - F.ceil(F.col("n") * num / den - 1e-9) + 1
    rows = held.select("set", F.explode(F.slice("grams", F.lit(1), F.col("rare"))).alias("gram"))
    counted = rows.withColumn("df", F.count("*").over(Window.partitionBy("gram"))).where("df > 1")
    of = Window.partitionBy("set")
    sizes = held.select("set", "n", "rare")
    placed = counted.select("set", "gram", F.row_number().over(of.orderBy("df", "gram")).alias("place"), F.count("*").over(of).alias("shared")).join(sizes, "set")
    placed = placed.select(F.col("gram").alias("cell"), F.col("set").alias("id"), "n", (F.col("rare") - F.col("shared") + F.col("place") - 1).cast("int").alias("pos"))
    last = held.withColumn("left", (prefix - F.col("rare")).cast("int")).where("left > 0").select("set", "n", "rare", F.posexplode(F.slice("grams", F.col("rare") + 1, F.col("left"))).alias("at", "cell"))
    last = last.select("cell", F.col("set").alias("id"), "n", (F.col("rare") + F.col("at")).cast("int").alias("pos"))
    return placed.unionByName(last).where(F.col("pos") < prefix)


def _admits(num: int, den: int):
    """Whether what stands behind the places of a shared n-gram can make two sets linked: exact for the first n-gram that they share."""

    def admits(a: str, b: str) -> Column:
        behind = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
        return behind * (num + den) >= num * (F.col(f"{a}n") + F.col(f"{b}n"))

    return admits


def _closes(num: int, den: int):
    """Leaves the members of a cell that some member of it could still be linked with, by the least size and the best place in the cell."""

    def closes(left: DataFrame) -> DataFrame:
        spare = (F.col("n") - F.col("pos")) * (num + den) - num * F.col("n")
        best = left.groupBy("cell").agg(F.min("n").alias("_n"), F.max(spare).alias("_spare"))
        return left.join(best, "cell").where((spare >= num * F.col("_n")) & (F.col("_spare") >= num * F.col("n"))).drop("_n", "_spare")

    return closes


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of docs(doc_id, text).

    Two sets are linked when den * |A and B| >= num * |A or B|.  class_id: the smallest doc_id with the same
    set.  component_id: the smallest doc_id reachable by links.  Null and empty texts and texts without
    words have an empty set, a class and a component of their own.  Rows that repeat a doc_id are one
    document: their sets count as linked.  A null doc_id gives null ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id is not null")
    with C.Scratch(docs.sparkSession) as held:
        prints = held.save(fingerprints(docs, words), "prints")
        real = prints.where("doc_id is not null and n_shingles > 0").withColumnRenamed("f1", "set")
        classes = held.save(real.groupBy("set", "f2", "n_shingles").agg(F.min("doc_id").alias("class_id")), "classes")
        common = common_grams(named, words, held)
        sampled = held.save(samples(named, words, num, den, common), "samples")
        opened = held.save(open_sets(sampled).join(classes, "set").select(F.col("class_id").alias("doc_id"), "n_shingles"), "open")
        held.drop(sampled)
        with C.pruned_by_filter(docs.sparkSession):
            texts = named.join(opened.where("n_shingles > 0").select("doc_id"), "doc_id", "left_semi")
            grams = held.save(sets(texts, words, common), "sets")
        if not C.is_empty(grams.groupBy("set").count().where("count > 1")):  # rows that repeat a doc_id
            grams = held.save(grams.dropDuplicates(["set"]), "sets")
        placed = held.save(cells(grams, num, den), "cells")
        shared = placed.groupBy("cell").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("cell")
        crowded = held.save(placed.join(shared, "cell", "left_semi"), "crowded")
        held.drop(placed)

        def measure(pairs: DataFrame) -> DataFrame:
            both = pairs.join(grams.select(F.col("set").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("set").alias("b"), F.col("grams").alias("gb")), "b")
            both = both.select("a", "b", "ca", "cb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("common"), (F.size("ga") + F.size("gb")).cast("long").alias("total"))
            one = F.col("total") - F.col("common")
            return both.select("a", "b", "ca", "cb", (1 - F.col("common") / one).alias("dist"), (F.col("common") * den >= one * num).alias("linked")).distinct()

        links = C.link_cells(crowded, held, measure, "pos", _admits(num, den), 1 - num / den, _closes(num, den))
        # the sets of rows that repeat a doc_id are linked through it
        twice = real.groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("b")).where("a < b").select("doc_id", "a")
        twice = real.join(twice, "doc_id").select("a", F.col("set").alias("b"))
        found = C.components(links.unionByName(twice), held).select(F.col("id").alias("set"), F.col("component").alias("of"))
        whole = classes.join(found, "set", "left").withColumn("of", F.coalesce("of", "set"))
        whole = whole.join(whole.groupBy("of").agg(F.min("class_id").alias("component_id")), "of").select("set", "f2", "n_shingles", "class_id", "component_id")
        ids = prints.withColumnRenamed("f1", "set").join(whole, ["set", "f2", "n_shingles"], "left")
        ids = ids.select("doc_id", "n_shingles", *[F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c) for c in ("class_id", "component_id")])
        # rows that repeat a doc_id: the least of all
        least = ids.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("class_id").alias("least_class"), F.min("component_id").alias("least")).where("rows > 1").drop("rows")
        ids = ids.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least_class", "class_id").alias("class_id"), F.coalesce("least", "component_id").alias("component_id"))
        return C.save(ids, "jaccard")


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; other columns stay.  Rows without a doc_id stay."""
    out = jaccard_components(docs, words, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)

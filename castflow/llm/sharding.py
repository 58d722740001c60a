"""Sharding: balanced label propagation over linked documents, with exact and even sizes.

Documents with equal texts are linked through their group.  Every document starts in a shard given by a hash of its id.
In each round a join tells every document how many of its group each shard holds; it asks for the fullest
shard with free quota, and a shard grants requests by priority while its quota of linked documents lasts.  A
group asks as one, so it moves whole; a group of more than ``1 / GRAIN`` of a shard asks document by document.
At the end shards with too many rows give up surplus rows, unlinked ones first, to those with too few: all
counts are at most one apart.  Only counts for each shard and priority bucket reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castflow.llm import common as C

#: Priority buckets of the requests for a shard; the quota is used up to one bucket.
BUCKETS = 1024
GRAIN = 64


def _propagate(linked: DataFrame, shards: int, quota: int, rounds: int, scratch: C.Scratch) -> DataFrame:
    """linked (doc, group, size of group, shard) after the rounds, no shard above the quota unless it began so."""
    spark = linked.sparkSession
    for _ in range(rounds):
        held = {r[0]: r[1] for r in linked.groupBy("shard").count().collect()}  # one row for each shard
        room = [max(0, quota - held.get(s, 0)) for s in range(shards)]
        counts = linked.groupBy("group", "shard").agg(F.count("*").alias("n"))
        free = F.element_at(F.array(*[F.lit(r) for r in room]), F.col("shard") + 1)
        # the fullest shard of each group; a smaller group's home may be full, then the fullest with room
        best = counts.where(free > 0).groupBy("group").agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("b")).select("group", (-F.col("b.s")).alias("target"), F.col("b.n").alias("there"))
        here = linked.join(counts, ["group", "shard"]).join(best, "group", "left")
        # documents only move to where more of their group are, or as many in a lower shard
        wants = (F.col("target") != F.col("shard")) & ((F.col("there") > F.col("n")) | ((F.col("there") == F.col("n")) & (F.col("target") < F.col("shard"))))
        who = F.when(F.col("size") * GRAIN > quota, F.xxhash64("doc")).otherwise(F.xxhash64("group"))
        asked = scratch.save(here.select("doc", "group", "size", "shard", F.when(wants, F.col("target")).alias("target"), F.pmod(who, F.lit(BUCKETS)).cast("int").alias("bucket")), "asked")
        requests = asked.where("target is not null").groupBy("target", "bucket").count().collect()  # at most shards * BUCKETS rows
        limit = [0] * shards
        for s in range(shards):
            per, left = {r[1]: r[2] for r in requests if r[0] == s}, room[s]
            while limit[s] < BUCKETS and per.get(limit[s], 0) <= left:
                left -= per.get(limit[s], 0)
                limit[s] += 1
        granted = F.col("bucket") < F.element_at(F.array(*[F.lit(x) for x in limit]), F.col("target") + 1)
        before, linked = linked, scratch.save(asked.select("doc", "group", "size", F.when(F.col("target").isNotNull() & granted, F.col("target")).otherwise(F.col("shard")).alias("shard")), "shards")
        scratch.drop(before, asked)
        if not requests or not any(limit[r[0]] > r[1] for r in requests):
            break
    return linked


def balanced(docs: DataFrame, shards: int = 8, rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, group_id, shard, slot for every row of docs(doc_id, text); law ``rows``.

    Shards are 0 to shards - 1, their row counts at most one apart, slots gapless from 0 in each.  A null
    text has size 1 and the CRC of no bytes, and is linked with empty texts.  Rows that repeat a doc_id, or have none, are
    rows of their own, told apart by their text; equal rows are alike, so either may get either place.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group"))
    with C.Scratch(docs.sparkSession) as scratch:
        rows = scratch.save(rows.withColumn("doc", F.monotonically_increasing_id()), "documents")
        total = rows.count()
        quota = total // shards
        start = F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int").alias("shard")
        groups = rows.groupBy("group").agg(F.count("*").alias("of")).where("of > 1")
        linked = scratch.save(rows.join(groups, "group").select("doc", "group", F.col("of").alias("size"), start), "shards")
        moved = _propagate(linked, shards, quota, rounds, scratch).select("doc", F.col("shard").alias("to"))
        placed = rows.withColumn("start", start).join(moved, "doc", "left")
        placed = placed.select("doc_id", "size", "text_crc32", F.col("group").alias("group_id"), F.coalesce("to", "start").alias("at"), F.col("to").isNull().alias("alone"))
        # linked documents come first in a shard's order, so surplus rows are unlinked ones as long as there are any
        ranks = C.save(C.ranked(placed, [F.col("at")], [F.col("alone"), F.xxhash64("group_id"), F.col("doc_id")], scratch), "ranks")
    held = {r[0]: r[1] for r in ranks.groupBy("at").count().collect()}  # one row for each shard
    # the larger counts go to the shards that hold the most
    most = sorted(range(shards), key=lambda s: (-held.get(s, 0), s))[: total % shards]
    want = [quota + (s in most) for s in range(shards)]
    have = [held.get(s, 0) for s in range(shards)]
    over = [max(0, h - w) for h, w in zip(have, want, strict=True)]
    under = [max(0, w - h) for h, w in zip(have, want, strict=True)]
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("at") + 1)
    surplus = F.col("rank") - pick(want) + pick([sum(over[:s]) for s in range(shards)])  # gapless from 0 over all shards
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in reversed(range(shards)):
        first = sum(under[:s])
        mine = (surplus >= first) & (surplus < first + under[s])
        shard, slot = F.when(mine, s).otherwise(shard), F.when(mine, surplus - first + min(have[s], want[s])).otherwise(slot)
    stays = F.col("rank") < pick(want)
    return ranks.select("doc_id", "size", "text_crc32", "group_id", F.when(stays, F.col("at")).otherwise(shard).alias("shard"), F.when(stays, F.col("rank")).otherwise(slot).cast("long").alias("slot"))


def cut_edges(sharded: DataFrame) -> DataFrame:
    """(linked, together): documents with an equal text elsewhere, and those of them in their group's fullest shard."""
    per = sharded.groupBy("group_id", "shard").agg(F.count("*").alias("n")).groupBy("group_id").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
    return per.agg(F.sum("n").alias("linked"), F.sum("most").alias("together"))

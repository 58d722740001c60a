"""A stored index of notes by word: what a search reads are the asked words' buckets, not the notes.

    path/words/bucket=<b>/run=<r>/...   (word, note), sorted by word: which notes of a run hold it, by their numbers in the run
    path/notes/batch_id=<n>/...         (feed_id, episode_id, content, run, note): the notes of batch n and its run, content being a hash of the text

A batch adds the notes that are new or have changed.  A note that comes again with other text leaves its old rows behind, which count no more: a
row counts if a note's last batch names its run and number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from castflow.functions.storage import Staged, stored
from castflow.functions.text import words
from castflow.operators.notes import QUERY_PARTS
from castflow.schemas import KEY

WORDS = "word string, note long, bucket int, run long"
NOTES = "feed_id string, episode_id string, content long, run long, note long, batch_id long"
#: Up to so many asked words are named in the scan's filter.
NAMED_WORDS = 1000


class NoteIndex:
    """buckets: chosen once for a path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int")

    def notes(self) -> DataFrame:
        """(feed_id, episode_id, content, run, note, batch_id) of each note as it was added last."""
        all_ = stored(self.spark, "parquet", NOTES, f"{self.path}/notes")
        last = F.max_by(F.struct("content", "run", "note", "batch_id"), "batch_id").alias("n")
        return all_.groupBy(*KEY).agg(last).select(*KEY, "n.*")

    def add(self, notes: DataFrame) -> None:
        """Adds the notes(feed_id, episode_id, markdown) that are not there with the same text.  One batch is added at a time.

        The list of notes is written last: nothing of a batch that is broken off before counts, as no list names its run.
        """
        known, run = self.notes(), uuid.uuid4().int >> 65
        batch_id = (known.agg(F.max("batch_id")).first()[0] or 0) + 1
        with Staged(self.spark) as staged:
            fresh = notes.select(*KEY, "markdown", F.xxhash64(F.coalesce("markdown", F.lit(""))).alias("content"))
            fresh = fresh.join(known.select(*KEY, "content"), [*KEY, "content"], "left_anti")
            fresh = staged.save(fresh.withColumn("note", F.monotonically_increasing_id()), "index")
            rows = fresh.select(F.explode(words(F.coalesce("markdown", F.lit("")))).alias("word"), "note").withColumns({"bucket": self._bucket(), "run": F.lit(run)})
            even = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "run", "word")
            even.write.partitionBy("bucket", "run").option("parquet.bloom.filter.enabled#word", "true").mode("append").parquet(f"{self.path}/words")
            self._list(fresh.select(*KEY, "content", F.lit(run).alias("run"), "note"), batch_id)

    def _list(self, fresh: DataFrame, batch_id: int) -> None:
        fresh.write.mode("overwrite").parquet(f"{self.path}/notes/batch_id={batch_id}")

    def postings(self, asked: DataFrame) -> DataFrame:
        """The rows of the words(word) that are asked: of their buckets alone, and by name where they are few."""
        buckets = [r.b for r in asked.select(self._bucket().alias("b")).distinct().collect()]  # at most all buckets
        some = [r.word for r in asked.select("word").distinct().take(NAMED_WORDS + 1)]
        found = stored(self.spark, "parquet", WORDS, f"{self.path}/words").where(F.col("bucket").isin(buckets))
        return found.where(F.col("word").isin(some)) if len(some) <= NAMED_WORDS else found

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, feed_id, episode_id, hits, rank): as ``notes.search_notes`` over all notes that were added."""
        asked = queries.select("query_id", F.explode(words("text")).alias("word"))
        by_word = asked.groupBy(F.col("word"), F.pmod(F.xxhash64("query_id"), F.lit(QUERY_PARTS)).alias("part")).agg(F.collect_set("query_id").alias("_asked"))
        rows = self.postings(asked).join(by_word, "word").select("run", "note", F.explode("_asked").alias("query_id"))
        hits = rows.groupBy("query_id", "run", "note").agg(F.count("*").alias("hits"))  # keys of a few bytes
        live = hits.join(self.notes().select("run", "note", *KEY), ["run", "note"]).select("query_id", *KEY, "hits")
        w = Window.partitionBy("query_id").orderBy(F.desc("hits"), *KEY)
        return live.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

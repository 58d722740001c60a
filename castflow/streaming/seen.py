"""The keys of all episodes ever seen, in buckets of feeds: what a pull reads of it depends on its own feeds, not on all that was ever seen.

    path/bucket=<b>/batch_id=<n>/...    the keys that batch n added
    path/bucket=<b>/batch_id=-<m>/...   the keys of all batches before m, put together

A feed's keys are all in one bucket.  Files are sorted by feed and hold Spark's Parquet statistics and Bloom filters of it, so of a large bucket only
the row groups that may hold a pull's feeds are read.  A key that stands there twice counts once: that makes compaction safe beside a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castflow.functions.storage import empty, stored
from castflow.schemas import KEY

SCHEMA = "feed_id string, episode_id string, bucket int, batch_id long"
#: Up to so many feeds of a pull are named in the scan's filter.
NAMED_FEEDS = 1000


class SeenTable:
    """buckets: chosen once for a path; a bucket should hold some hundred megabytes of keys at most."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self, feed: str = "feed_id") -> Column:
        return F.pmod(F.xxhash64(feed), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return stored(self.spark, "parquet", SCHEMA, self.path)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without the folders that a compaction repeats: they are the next to go.  One number for each bucket is gathered."""
        least = {r.bucket: -r.m for r in rows.groupBy("bucket").agg(F.min("batch_id").alias("m")).where("m < 0").collect()}
        if not least:
            return rows
        upto = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("bucket")), F.lit(0))
        return rows.where((F.col("batch_id") >= upto) | (F.col("batch_id") == -upto))

    def all(self) -> DataFrame:
        return self._live(self._stored())

    def among(self, feeds: DataFrame) -> DataFrame:
        """The keys that may be those of a pull of these feeds(feed_id): of their buckets, and of them by name where they are few."""
        feeds = feeds.select("feed_id").distinct()
        buckets = [r.b for r in feeds.select(self.bucket().alias("b")).distinct().collect()]  # at most all buckets
        some = [r.feed_id for r in feeds.take(NAMED_FEEDS + 1)]
        found = self._live(self._stored().where(F.col("bucket").isin(buckets)))
        return found.where(F.col("feed_id").isin(some)) if len(some) <= NAMED_FEEDS else found

    def new(self, pulled: DataFrame, batch_id: int | None = None, feeds: DataFrame | None = None) -> DataFrame:
        """The pull's episodes that were never seen, or only by the batch itself, which is run again.

        feeds: a table that has the pull's feed_ids and costs less to read than the pull.
        """
        seen = self.among(pulled if feeds is None else feeds)
        seen = seen if batch_id is None else seen.where(F.col("batch_id") != batch_id)
        return pulled.join(seen.select(*KEY), KEY, "left_anti")

    def add(self, keys: DataFrame, batch_id: int) -> None:
        """Adds the keys of a batch (0 or more), in place of those that an earlier try of it left."""
        rows = keys.select(*KEY, self.bucket().alias("bucket"), F.lit(batch_id).cast("long").alias("batch_id"))
        self._write(rows)

    def _write(self, rows: DataFrame) -> None:
        even = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "batch_id", *KEY)  # a bucket of a huge feed is split
        to = even.write.partitionBy("bucket", "batch_id").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#feed_id", "true")
        to.mode("overwrite").parquet(self.path)

    def compact(self, bucket: int) -> bool:
        """Puts the batches of one bucket but the last together in one folder; whether there was anything to do.

        May run beside a stream and be broken off at any point: first the new folder comes, which only repeats keys, then the folders
        go that an earlier compaction had repeated already; whoever began to read since that one doesn't use them.
        """
        here = self._stored().where(F.col("bucket") == bucket)
        ids = sorted(r.batch_id for r in here.select("batch_id").distinct().collect())  # a row for each batch since the last time
        last = max((i for i in ids if i >= 0), default=0)
        before = -min([0, *ids])  # the batches that were put together already
        if last > before:
            self._write(here.where(F.col("batch_id") < last).select(*KEY, "bucket").distinct().withColumn("batch_id", F.lit(-last).cast("long")))
        gone = [i for i in ids if 0 <= i < before or -before < i < 0]
        for i in gone:
            empty(self.spark, f"{self.path}/bucket={bucket}/batch_id={i}")
        return last > before or bool(gone)

"""The increment as a stream over arriving feed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from castflow import schemas
from castflow.functions.storage import stored
from castflow.operators.increment import dedupe_episodes
from castflow.sources.feed_items import parse_feed_bytes
from castflow.sources.feeds import parse_feeds
from castflow.streaming.seen import SeenTable


def found_episodes(spark: SparkSession, state_path: str) -> DataFrame:
    """What the stream has found so far: EPISODES with batch_id; empty before the first batch."""
    return stored(spark, "parquet", schemas.EPISODES + ", batch_id long", f"{state_path.rstrip('/')}/episodes")


def seen_table(spark: SparkSession, state_path: str, buckets: int = 256) -> SeenTable:
    return SeenTable(spark, f"{state_path.rstrip('/')}/seen", buckets)


def run_batch(docs: DataFrame, batch_id: int, state_path: str, buckets: int = 256) -> None:
    """The new episodes of a batch of FEED_DOCS, or of documents as bytes, then their keys; a batch that is run again replaces what it left."""
    spark, seen = docs.sparkSession, seen_table(docs.sparkSession, state_path, buckets)
    path = f"{state_path.rstrip('/')}/episodes/batch_id={batch_id}"
    pulled = parse_feed_bytes(docs) if "content" in docs.columns else parse_feeds(docs)
    seen.new(dedupe_episodes(pulled), batch_id, docs).write.mode("overwrite").parquet(path)
    seen.add(stored(spark, "parquet", schemas.EPISODES, path), batch_id)


def start_increment_stream(feed_stream: DataFrame, state_path: str, checkpoint: str, buckets: int = 256, **trigger) -> StreamingQuery:
    """Starts a query that appends the new episodes of each batch of FEED_DOCS, or of documents as bytes, under ``state_path``/episodes/batch_id=...

    All keys ever seen are kept in a table by buckets of feeds (``seen.SeenTable``), not in stream state, as feeds repeat their history
    for ever; a batch reads the buckets of its own feeds.  ``buckets`` stays the same for a path.  Buckets may be compacted while the stream runs.
    """
    trigger = trigger or {"availableNow": True}
    batch = lambda docs, batch_id: run_batch(docs, batch_id, state_path, buckets)
    return feed_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()

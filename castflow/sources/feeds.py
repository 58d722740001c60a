"""Stored feed documents and their episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "guid string, title string, description string, pubDate string, `itunes:duration` string, enclosure struct<_url:string>"
RSS = f"channel struct<title:string, item:array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in ITEM.split(','))}>>>"


def read_feed_docs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """FEED_DOCS of XML files under ``path``/feed_id=.../; with stream, as a stream."""
    reader = spark.readStream if stream else spark.read
    files = reader.schema("value string, feed_id string").text(path, wholetext=True)
    return files.select("feed_id", F.col("_metadata.file_modification_time").alias("fetched_at"), F.col("value").alias("xml"))


def write_feed_docs(feed_docs: DataFrame, path: str) -> None:
    """One file for each document: a file's whole text is one feed."""
    feed_docs.select("feed_id", "xml").write.partitionBy("feed_id").option("maxRecordsPerFile", 1).option("lineSep", "\n").mode("append").text(path)


def episode_id(guid: Column, url: Column, title: Column, pub_date: Column) -> Column:
    """What names an episode in its feed; never null."""
    other = F.sha2(F.concat_ws("|", title, pub_date.cast("string")), 256)
    return F.coalesce(F.when(guid != "", guid), F.when(url != "", url), other)


def _parsed(feed_docs: DataFrame, most_chars: int | None) -> DataFrame:
    xml = F.col("xml") if most_chars is None else F.when(F.length("xml") <= most_chars, F.col("xml"))
    return feed_docs.withColumn("rss", F.from_xml(xml, RSS, {"rowTag": "rss"}))


def episodes_of(items: DataFrame) -> DataFrame:
    """EPISODES of items(feed_id, guid, title, description, pubDate, itunes:duration, url) as the feeds write them."""
    day = F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", "")
    clock = F.split("`itunes:duration`", ":")
    parts = F.transform(F.reverse(clock), lambda p, k: p.try_cast("int") * F.element_at(F.array(F.lit(1), F.lit(60), F.lit(3600)), k + 1))
    seconds = F.when(F.size(clock) <= 3, F.aggregate(parts, F.lit(0), lambda a, x: a + x))
    out = items.select("feed_id", "guid", "title", "description", F.try_to_timestamp(day, F.lit("dd MMM yyyy HH:mm:ss Z")).alias("pub_date"), seconds.alias("duration_s"), F.col("url").alias("enclosure_url"))
    named = out.withColumn("episode_id", episode_id(F.col("guid"), F.col("enclosure_url"), F.col("title"), F.col("pub_date")))
    return named.select("feed_id", "episode_id", "guid", "title", "description", "pub_date", "duration_s", "enclosure_url")


def parse_feeds(feed_docs: DataFrame, most_chars: int | None = None) -> DataFrame:
    """EPISODES, one row for each item of the readable documents; a document of more than most_chars is rejected.

    For documents as bytes, of other encodings, very long or broken ones, see ``feed_items``.
    """
    item = _parsed(feed_docs, most_chars).select("feed_id", F.explode("rss.channel.item").alias("i"))
    return episodes_of(item.select("feed_id", "i.guid", "i.title", "i.description", "i.pubDate", "i.`itunes:duration`", F.col("i.enclosure._url").alias("url")))


def rejected_feeds(feed_docs: DataFrame, most_chars: int | None = None) -> DataFrame:
    """The documents without a readable channel: malformed, cut off, empty, too long, or no feed at all."""
    return _parsed(feed_docs, most_chars).where("rss.channel is null").select(*feed_docs.columns)

"""The library's tables made from the driver's; test conventions, not behaviour."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CDN = "https://cdn-{}.example/{}/{}.mp3"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    url = F.concat(F.lit("https://cdn-"), (F.col("doc_id") % 7).cast("string"), F.lit(".example/"), F.col("source"), F.lit("/"), key, F.lit(".mp3"))
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    return docs.select(F.col("source").alias("feed_id"), key.alias("episode_id"), key.alias("guid"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), when.alias("pub_date"), F.floor(F.col("n_chars") / 15).cast("int").alias("duration_s"), url.alias("enclosure_url"))


def feed_docs(eps: DataFrame, per_doc: int = 100) -> DataFrame:
    """RSS documents of about per_doc episodes of a feed each; the writer takes no prefixed names, so one is put in."""
    item = F.struct("guid", "title", "description", F.concat(F.date_format("pub_date", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("pubDate"), F.col("duration_s").cast("string").alias("itunes_duration"), F.struct(F.col("enclosure_url").alias("_url")).alias("enclosure"))
    items = F.array_sort(F.collect_list(F.struct("_n", item.alias("i"))))
    rows = eps.withColumn("_n", F.col("episode_id").cast("long")).withColumn("_page", F.floor(F.col("_n") / F.lit(per_doc * 20)))
    docs = rows.groupBy("feed_id", "_page").agg(items.alias("items"))
    channel = F.struct(F.struct(F.col("feed_id").alias("title"), F.transform("items", lambda x: x["i"]).alias("item")).alias("channel"))
    return docs.select("feed_id", F.lit("2024-06-01").cast("timestamp").alias("fetched_at"), F.replace(F.to_xml(channel, {"rowTag": "rss"}), F.lit("itunes_duration>"), F.lit("itunes:duration>")).alias("xml"))


def feed_bytes(docs: DataFrame) -> DataFrame:
    """FEED_DOCS as bytes: a third each in UTF-8, UTF-16 and GB 18030; where the source number is divisible by 5 an item is cut off at the end."""
    number = F.substring("feed_id", 4, 10).cast("int")
    cut = F.when(number % 5 == 0, F.regexp_replace("xml", r"</channel>\s*</rss>\s*$", "<item><guid>cut</guid><title>of")).otherwise(F.col("xml"))
    rows = docs.select("feed_id", "fetched_at", cut.alias("xml"), F.element_at(F.array(*map(F.lit, ("utf-8", "utf-16", "gb18030"))), number % 3 + 1).alias("name"))

    def run(batches):
        for batch in batches:
            made = [f'<?xml version="1.0" encoding="{n.as_py()}"?>\n{x.as_py()}'.encode(n.as_py()) for x, n in zip(batch.column("xml"), batch.column("name"), strict=True)]
            yield pa.record_batch([batch.column("feed_id"), batch.column("fetched_at"), pa.array(made, pa.binary())], ["feed_id", "fetched_at", "content"])

    return rows.mapInArrow(run, "feed_id string, fetched_at timestamp, content binary")


def labelled(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Keys of the documents with a label, and more of the label; the episodes that were seen."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id", *more), "doc_id").select(F.col("source").alias("feed_id"), F.col("doc_id").cast("string").alias("episode_id"), *more)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    zone = F.when(~good, "pending").when(F.col("toxic") == 1, "converted").otherwise("confirmed")
    return docs.select(F.col("source").alias("feed_id"), F.col("doc_id").cast("string").alias("episode_id"), zone.alias("zone"), (good | (F.col("doc_id") % 5 == 0)).alias("checked"), F.col("doc_id").cast("int").alias("line_no"), F.substring_index("text", "\n", 1).alias("title"), F.lit(None).cast("string").alias("summary"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("feed_id"), F.col("doc_id").cast("string").alias("episode_id"), "text", "n_chars")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """66 ms a character, end to end; a turn whose number leaves 2 over 3 starts 5,000 ms late."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("text") * 66
    end = F.sum(length + F.when(F.col("turn") % 3 == 2, 5000).otherwise(0)).over(w)
    rows = table(spark, sf_dir, "conversations").withColumn("end_ms", end.cast("long"))
    return rows.select(F.lit("conversations").alias("feed_id"), F.col("conv_id").cast("string").alias("episode_id"), F.col("turn").cast("int").alias("seg_no"), (F.col("end_ms") - length).cast("long").alias("start_ms"), "end_ms", "text")


def segment_audio(segs: DataFrame) -> DataFrame:
    last = segs.groupBy("feed_id", "episode_id").agg(F.max("end_ms").alias("e"))
    longer = F.col("episode_id").cast("long") % 5 == 0
    return last.select("feed_id", "episode_id", F.concat(F.lit("audio/"), "episode_id").alias("path"), F.when(longer, F.floor(F.col("e") * 1.25)).otherwise(F.col("e")).cast("long").alias("duration_ms"))


def kept_segments(segs: DataFrame) -> DataFrame:
    return segs.where(F.col("episode_id").cast("long") % 11 != 0)


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(spark, sf_dir).where(F.col("guid").cast("long") % 4 != 0).select("feed_id", "episode_id", F.concat(F.lit("audio/"), "episode_id").alias("path"), F.lit(1000).cast("long").alias("duration_ms"))


def transcribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(spark, sf_dir).where(F.col("guid").cast("long") % 3 == 0).select("feed_id", "episode_id")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 2 == 1, F.col("url")).otherwise(F.concat(F.lit("https://podcasts.apple.com/cn/podcast/x/id"), F.col("page_id").cast("string"), F.lit("?i=1")))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("link_id"), url.alias("url"))


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("page_id % 6 <> 0").select(F.col("page_id").cast("string").alias("show_id"), F.col("url").alias("feed_url"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "benchmark")
    style = F.concat(F.lit("s"), (F.col("item_id") % 3).cast("string"))
    return item.select(F.col("item_id").cast("string").alias("template_id"), style.alias("style"), F.col("text").alias("description"), F.array(F.lit("TL;DR"), F.concat(F.lit("Topics "), style)).alias("required_sections"), F.lit("body").alias("body"))


def requests(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select((F.col("user_id") % 3).alias("run_id"), F.lit("note").alias("kind"), F.col("user_id" if by_user else "event_id").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_s"), F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"))


def chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    attempt = F.row_number().over(Window.partitionBy("user_id", F.col("event_id") % 10).orderBy("ts", "event_id"))
    return events.select(F.lit("events").alias("feed_id"), F.col("user_id").cast("string").alias("episode_id"), (F.col("event_id") % 10).cast("int").alias("chunk_no"), attempt.alias("attempt"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.lit("s").alias("summary"))

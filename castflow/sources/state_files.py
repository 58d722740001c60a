"""State files: one Markdown document for each source, with three zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Zone headings, in their order in a file (fixed values of the format).
ZONES = {"pending": "待确认", "confirmed": "确认", "converted": "已转化"}
_ENTRY = r"^\s*- \[([ xX])\]\s*(.*?)(?: — (.*?))?\s*<!-- id:(.*?) -->\s*$"


def zone_rank(zone):
    rank = F.lit(None).cast("int")
    for i, z in enumerate(ZONES):
        rank = F.when(zone == z, i).otherwise(rank)
    return rank


def render_state(state: DataFrame) -> DataFrame:
    """(feed_id, markdown): a feed's entries by zone and line, an empty zone with its heading alone.

    Only the lines of a feed are gathered, never descriptions.  Line breaks and the mark before a summary are made plain.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "), " — ", " - ")
    summary = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" — "), plain(F.col("summary")))).otherwise("")
    line = F.concat(F.lit("- ["), F.when(F.col("checked"), "x").otherwise(" "), F.lit("] "), plain(F.col("title")), summary, F.lit(" <!-- id:"), F.col("episode_id"), F.lit(" -->"))
    rows = F.array_sort(F.collect_list(F.struct(zone_rank(F.col("zone")).alias("zone"), "line_no", "episode_id", line.alias("line"))))
    files = state.where(zone_rank(F.col("zone")).isNotNull()).groupBy("feed_id").agg(rows.alias("rows"))
    def section(rank: int, heading: str):
        return F.concat(F.array(F.lit(f"## {heading}")), F.transform(F.filter("rows", lambda r: r["zone"] == rank), lambda r: r["line"]))

    zones = [section(i, h) for i, h in enumerate(ZONES.values())]
    return files.select("feed_id", F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.col("feed_id"))), *zones), "\n").alias("markdown"))


def write_state(state: DataFrame, path: str) -> None:
    render_state(state).withColumnRenamed("markdown", "value").write.partitionBy("feed_id").mode("overwrite").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema("value string, feed_id string").text(path, wholetext=True)
    lines = files.select("feed_id", F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    heading = F.regexp_extract("line", r"^\s*##\s*(.*?)\s*$", 1)
    zone = F.lit("unknown")
    for z, h in ZONES.items():
        zone = F.when(heading == h, z).otherwise(zone)
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("zone", F.last(F.when(F.col("line").rlike(r"^\s*##\s"), zone), True).over(w))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """STATE of all files: entries under the three headings, numbered within their file from 1."""
    entry = lambda g: F.regexp_extract("line", _ENTRY, g)
    rows = _lines(spark, path).where(F.col("line").rlike(_ENTRY) & F.col("zone").isin(*ZONES))
    place = F.row_number().over(Window.partitionBy("file").orderBy("pos"))
    return rows.select("feed_id", entry(4).alias("episode_id"), "zone", (F.lower(entry(1)) == "x").alias("checked"), place.alias("line_no"), entry(2).alias("title"), F.when(entry(3) != "", entry(3)).alias("summary"))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """(feed_id, pos, line) of what is neither a title, a heading, blank nor an entry of a known zone."""
    known = F.col("line").rlike(_ENTRY) & F.coalesce(F.col("zone").isin(*ZONES), F.lit(False))
    plain = F.col("line").rlike(r"^\s*$") | F.col("line").rlike(r"^# ") | (F.col("line").rlike(r"^\s*##\s") & (F.col("zone") != "unknown"))
    return _lines(spark, path).where(~known & ~plain).select("feed_id", "pos", "line")

"""Metadata, transcript segments, templates and notes as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castflow import schemas
from castflow.sources.merged import MergedTable


def metadata_table(spark: SparkSession, path: str) -> MergedTable:
    return MergedTable(spark, path, schemas.EPISODES, schemas.KEY)


def write_metadata(episodes: DataFrame, path: str) -> None:
    """Merges EPISODES into the JSON lines at the path, one folder for each feed: an episode that is there already is replaced."""
    metadata_table(episodes.sparkSession, path).merge(episodes)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return metadata_table(spark, path).read()


def segments_table(spark: SparkSession, path: str, form: str = "text") -> MergedTable:
    """An episode's segments are replaced together: a new transcript may have fewer."""
    keyed = (lambda df: df.withColumn("episode_id", F.regexp_extract("value", r"^([^\t]*)\t", 1))) if form == "text" else (lambda df: df)
    unique = ["feed_id", F.regexp_extract("value", r"^[^\t]*\t\d+", 0)] if form == "text" else [*schemas.KEY, "seg_no"]
    return MergedTable(spark, path, schemas.SEGMENTS, schemas.KEY, form, keyed, unique)


def write_segments(segments: DataFrame, path: str, form: str = "text") -> None:
    """Merges SEGMENTS, one folder for each feed: lines ``episode TAB number TAB [start-end] text``, or JSON lines."""
    if form == "text":
        text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        line = F.concat("episode_id", F.lit("\t"), F.col("seg_no").cast("string"), F.lit("\t["), F.col("start_ms").cast("string"), F.lit("-"), F.col("end_ms").cast("string"), F.lit("] "), text)
        segments = segments.select("feed_id", line.alias("value"))
    segments_table(segments.sparkSession, path, form).merge(segments, 1_000_000)


def read_segments(spark: SparkSession, path: str, form: str = "text") -> DataFrame:
    """SEGMENTS as written; lines of another form are left out."""
    lines = segments_table(spark, path, form).read()
    if form == "json":
        return lines
    form_ = r"^([^\t]*)\t(\d+)\t\[(\d+)-(\d+)\] (.*)$"
    part = lambda g: F.regexp_extract("value", form_, g)
    raw = F.split(part(5), r"\\\\", -1)  # pieces between escaped backslashes; the others stand before n
    text = F.array_join(F.transform(raw, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")
    return lines.where(F.col("value").rlike(form_)).select("feed_id", part(1).alias("episode_id"), part(2).cast("int").alias("seg_no"), part(3).cast("long").alias("start_ms"), part(4).cast("long").alias("end_ms"), text.alias("text"))


def render_templates(templates: DataFrame) -> DataFrame:
    """(template_id, value): a template as Markdown with frontmatter, its description on one line."""
    value = F.concat(F.lit("---\nstyle: "), "style", F.lit("\ndescription: "), F.trim(F.regexp_replace("description", r"\s*\n\s*", " ")), F.lit("\nrequired_sections: ["), F.array_join("required_sections", ", "), F.lit("]\n---\n"), F.coalesce("body", F.lit("")))
    return templates.select("template_id", value.alias("value"))


def write_templates(templates: DataFrame, path: str) -> None:
    render_templates(templates).write.partitionBy("template_id").mode("overwrite").text(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """TEMPLATES of Markdown files under ``path``/template_id=.../; a file without frontmatter is left out."""
    form = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    files = spark.read.schema("value string, template_id string").text(path, wholetext=True).where(F.col("value").rlike(form))
    head = F.regexp_extract("value", form, 1)
    field = lambda name: F.regexp_extract(head, rf"(?m)^{name}:[ ]*(.*?)\s*$", 1)
    sections = F.filter(F.transform(F.split(F.regexp_replace(field("required_sections"), r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda s: s != "")
    return files.select("template_id", field("style").alias("style"), field("description").alias("description"), sections.alias("required_sections"), F.regexp_replace(F.regexp_extract("value", form, 2), "\n$", "").alias("body"))


def notes_table(spark: SparkSession, path: str) -> MergedTable:
    return MergedTable(spark, path, schemas.NOTES, schemas.KEY)


def write_notes(notes: DataFrame, path: str, most_rows: int = 10_000) -> None:
    """Merges NOTES into the JSON lines at the path, one folder for each feed: an episode's older note is replaced, all others stay."""
    notes_table(notes.sparkSession, path).merge(notes, most_rows)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return notes_table(spark, path).read()

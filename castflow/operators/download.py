"""Plans for downloads, clean-up and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castflow.schemas import KEY


def download_manifest(picks: DataFrame, episodes: DataFrame, audio: DataFrame, transcripts: DataFrame, spacing_s: int) -> DataFrame:
    """(feed_id, episode_id, enclosure_url, host, seq, offset_s): picks still to fetch, one serial lane for each host.

    Picks without an address, and those with audio or a transcript, are left out.
    """
    urls = episodes.where("coalesce(enclosure_url, '') <> ''").groupBy(*KEY).agg(F.min("enclosure_url").alias("enclosure_url"))
    todo = picks.select(*KEY).distinct().join(urls, KEY).join(audio.select(*KEY), KEY, "left_anti").join(transcripts.select(*KEY), KEY, "left_anti")
    todo = todo.withColumn("host", F.coalesce(F.try_parse_url("enclosure_url", F.lit("HOST")), F.lit("")))
    todo = todo.withColumn("seq", F.row_number().over(Window.partitionBy("host").orderBy(*KEY)))
    return todo.withColumn("offset_s", (F.col("seq") - 1) * spacing_s)


def cleanup_candidates(audio: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Audio whose transcript is there."""
    return audio.join(transcripts.select(*KEY), KEY, "left_semi")


def redownload_list(wanted: DataFrame, episodes: DataFrame, audio: DataFrame) -> DataFrame:
    """Wanted episodes without audio, with the address from the metadata."""
    urls = episodes.where("coalesce(enclosure_url, '') <> ''").groupBy(*KEY).agg(F.min("enclosure_url").alias("enclosure_url"))
    return wanted.select(*KEY).distinct().join(urls, KEY).join(audio.select(*KEY), KEY, "left_anti")

"""What is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castflow.schemas import KEY


def pending_work(items: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Items without a finished result."""
    keys = keys or KEY
    return items.join(done.select(*keys), keys, "left_anti")


def transcription_worklist(audio: DataFrame, checks: DataFrame) -> DataFrame:
    """Audio without a complete transcript; checks: of check_duration."""
    return audio.join(checks.where("complete").select(*KEY), KEY, "left_anti")


def chunks_to_retry(chunks: DataFrame, results: DataFrame, max_attempts: int) -> DataFrame:
    """chunks whose latest attempt failed, with attempts left, or that have none; with the number of the last attempt."""
    latest = results.groupBy(*KEY, "chunk_no").agg(F.max("attempt").alias("attempt"), F.max_by("status", "attempt").alias("status"))
    out = chunks.join(latest, [*KEY, "chunk_no"], "left")
    again = F.col("attempt").isNull() | ((F.coalesce("status", F.lit("")) != "ok") & (F.col("attempt") < max_attempts))
    return out.where(again).drop("status").withColumn("attempt", F.coalesce("attempt", F.lit(0)))

"""The three zones of the state and the user's ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castflow.schemas import KEY


def attach_summaries(state: DataFrame, summaries: DataFrame) -> DataFrame:
    """state with the summaries of its entries; entries without one keep what they have."""
    found = summaries.groupBy(*KEY).agg(F.max("summary").alias("_new"))
    out = state.join(found, KEY, "left").withColumn("summary", F.coalesce("_new", "summary"))
    return out.select(*state.columns)


def picked(state: DataFrame) -> DataFrame:
    """Ticked entries that are not converted yet."""
    return state.where("checked and zone <> 'converted'")


def advance_zones(state: DataFrame, done: DataFrame) -> DataFrame:
    """state after a step: pending and ticked becomes confirmed, confirmed and done becomes converted; nothing goes back."""
    finished = done.select(*KEY).distinct().withColumn("_done", F.lit(True))
    zone = F.when((F.col("zone") == "pending") & F.col("checked"), "confirmed").when((F.col("zone") == "confirmed") & F.coalesce("_done", F.lit(False)), "converted").otherwise(F.col("zone"))
    return state.join(finished, KEY, "left").withColumn("zone", zone).select(*state.columns)

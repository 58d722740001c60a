"""New episodes, once and only once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castflow.schemas import KEY


def dedupe_episodes(pulled: DataFrame) -> DataFrame:
    """The newest version of each episode, ties by a hash of the row. Versions are reduced before they are shuffled."""
    order = F.struct(F.coalesce("pub_date", F.lit("0001-01-01").cast("timestamp")), F.xxhash64(*pulled.columns))
    return pulled.groupBy(*KEY).agg(F.max_by(F.struct(*pulled.columns), order).alias("e")).select("e.*")


def new_episodes(pulled: DataFrame, seen: DataFrame) -> DataFrame:
    """Episodes of the pull that were never seen. Keys are never null, so a second run adds nothing.

    ``seen`` only grows, so it is cut to the feeds of the pull first.
    """
    feeds = pulled.select("feed_id").distinct()
    known = seen.select(*KEY).join(feeds, "feed_id", "left_semi")
    return pulled.join(known, KEY, "left_anti")


def add_pending(state: DataFrame, new: DataFrame) -> DataFrame:
    """state with the new episodes as unticked pending entries; existing entries are untouched."""
    fresh = dedupe_episodes(new).join(state.select(*KEY), KEY, "left_anti")
    rows = fresh.select(*KEY, F.lit("pending").alias("zone"), F.lit(False).alias("checked"), F.lit(None).cast("int").alias("line_no"), "title", F.lit(None).cast("string").alias("summary"))
    return state.unionByName(rows, allowMissingColumns=True)

"""Running values over long sequences: parts of time that are summed up on their own, and what the parts before carry over.

A window over all rows of a run is one task, however long the run.  Here the whole table's times are cut at quantiles; a run's rows of one part are a
window of their own, and only a row for each run and part goes through a window by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _place(value: Column, cuts: list[int], low: int, high: int) -> Column:
    """The number of cuts below the value, between low and high, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value <= cuts[middle], _place(value, cuts, low, middle)).otherwise(_place(value, cuts, middle + 1, high))


def in_parts(df: DataFrame, value: Column, parts: int | None = None) -> DataFrame:
    """df with ``_part``: where the value stands among the cuts, which rise with it; -1 for null.  Equal values share a part.

    About ``parts`` (four for each shuffle partition, up to 1024) quantiles of the whole table are the cuts; only these numbers reach the driver.
    """
    parts = parts or min(1024, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    quantiles = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0]
    cuts = sorted(set(quantiles or []))
    return df.withColumn("_part", F.when(value.isNull(), F.lit(-1)).otherwise(_place(value, cuts, 0, len(cuts))))


def before_part(key: str):
    """The window of all parts of a key before a part."""
    return Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

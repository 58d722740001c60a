"""Checks of a log of model calls against the pacing policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castflow.functions.scan import before_part, in_parts

#: The policy's steps of allowed concurrency (fixed values).
SUMMARY_LADDER, NOTES_LADDER = (20, 15), (20, 15, 10)


def _micros(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def spacing_violations(requests: DataFrame, min_gap_s: float) -> DataFrame:
    """Requests less than min_gap_s after the one before in their run, with the gap in microseconds.

    A run of any length is spread over parts of time (``functions.scan``); the first request of a part is held against the last one before it.
    """
    rows = in_parts(requests, _micros())
    ends = rows.groupBy("run_id", "_part").agg(F.max(_micros()).alias("_end"))
    ends = ends.select("run_id", "_part", F.max("_end").over(before_part("run_id")).alias("_end"))
    w = Window.partitionBy("run_id", "_part").orderBy("ts", "item_id")
    rows = rows.withColumns({"_before": F.lag(_micros()).over(w), "_first": F.row_number().over(w) == 1}).join(ends, ["run_id", "_part"])
    gap = _micros() - F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_before"))
    return rows.select(*requests.columns, gap.alias("gap_us")).where(F.col("gap_us") < int(min_gap_s * 1_000_000))


def peak_concurrency(requests: DataFrame) -> DataFrame:
    """(run_id, peak): the most calls in flight; a call is from ts to ts + latency, its end not included.

    Each part of time gives its own highest sum, to which the calls that began and did not end before it are added.
    """
    end = _micros() + F.round(F.col("latency_s") * 1_000_000).cast("long")
    edges = requests.select("run_id", F.explode(F.array(F.struct(_micros().alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("e")).select("run_id", "e.*")
    # edges of one instant count together, so half-open calls of no length never count
    per = in_parts(edges.groupBy("run_id", "t").agg(F.sum("d").alias("d")), F.col("t"))
    flying = F.sum("d").over(Window.partitionBy("run_id", "_part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    parts = per.withColumn("n", flying).groupBy("run_id", "_part").agg(F.max("n").alias("n"), F.sum("d").alias("d"))
    carried = F.coalesce(F.sum("d").over(before_part("run_id")), F.lit(0))
    return parts.withColumn("n", F.col("n") + carried).groupBy("run_id").agg(F.max("n").alias("peak"))


def allowed_concurrency(requests: DataFrame, ladder: tuple[int, ...] = NOTES_LADDER, errors_per_step: int = 1) -> DataFrame:
    """requests with ``allowed``: the ladder's step after the 429s before the call, counted by parts of time."""
    rows = in_parts(requests, _micros()).withColumn("_error", F.when(F.col("status") == 429, 1).otherwise(0))
    carried = rows.groupBy("run_id", "_part").agg(F.sum("_error").alias("_carried"))
    carried = carried.select("run_id", "_part", F.coalesce(F.sum("_carried").over(before_part("run_id")), F.lit(0)).alias("_carried"))
    w = Window.partitionBy("run_id", "_part").orderBy("ts", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_errors", F.coalesce(F.sum("_error").over(w), F.lit(0))).join(carried, ["run_id", "_part"])
    step = F.least(F.floor((F.col("_errors") + F.col("_carried")) / errors_per_step), F.lit(len(ladder) - 1)).cast("int")
    return rows.select(*requests.columns, F.element_at(F.array(*map(F.lit, ladder)), step + 1).alias("allowed"))


def retry_schedule(requests: DataFrame, base_s: float = 2.0, max_s: float | None = None) -> DataFrame:
    """(item_id, streak, delay_s, next_us) of items whose last call was throttled: the delay doubles with each 429 in a row."""
    w = Window.partitionBy("item_id").orderBy("ts", "run_id")
    good = F.sum(F.when(F.col("status") != 429, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = requests.withColumn("_island", good).withColumn("_us", _micros())
    last = rows.groupBy("item_id", "_island").agg(F.sum(F.when(F.col("status") == 429, 1).otherwise(0)).alias("streak"), F.max("_us").alias("_us"))
    last = last.groupBy("item_id").agg(F.max_by(F.struct("streak", "_us"), "_island").alias("l")).select("item_id", "l.*").where("streak > 0")
    delay = F.lit(base_s) * F.pow(F.lit(2.0), F.col("streak") - 1)
    last = last.withColumn("delay_s", F.least(delay, F.lit(float(max_s))) if max_s is not None else delay)
    return last.select("item_id", "streak", "delay_s", (F.col("_us") + (F.col("delay_s") * 1_000_000).cast("long")).alias("next_us"))

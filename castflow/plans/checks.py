"""What a physical plan holds and reads; for tests that pin join strategies, pushdown and input.  Spark's plan has no public form in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scanned_bytes(df: DataFrame) -> int:
    """Runs a plan without exchanges and gives the size of the files that its scans were given, after pruning."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("filesSize").value() for i in range(leaves.size()))

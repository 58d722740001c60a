"""Tables of files that are merged by key: what a run writes joins what is there, and shows all at once or not at all.

    path/data/run=<run>/feed_id=<feed>/...   the rows of a feed, whole, as a run left them
    path/manifest/version=<n>/...            one small file for each run: the feeds whose rows are now in its folder

A run reads the feeds that its rows touch, and writes these feeds whole to a folder of its own, which nobody reads yet.  Its line in the manifest comes
last, as one file that Spark moves into place.  A run that is broken off before leaves a folder that no manifest names; the next run
starts from what the manifest shows.  Old folders stay, so readers are never disturbed, until ``vacuum``.
One run writes at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from castflow.functions.storage import Staged, empty, stored

MANIFEST = "feed_id string, run string, version long"


class MergedTable:
    """A table with feed_id, in one folder for each feed; the rows of one key are replaced together.

    form: of the files, json or text (one column ``value``), compressed.  The key's columns are among the table's, or ``keyed`` adds them.  unique: what
    names a row within a run (the key, if not given).  feed_id is never null.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], form: str = "json", keyed: Callable[[DataFrame], DataFrame] = lambda df: df, unique: list[str | Column] | None = None):
        self.spark, self.path, self.key, self.form, self.keyed, self.unique = spark, path.rstrip("/"), key, form, keyed, unique or key
        self.schema = ("value string, feed_id string" if form == "text" else schema) + ", run string"

    def _current(self) -> tuple[DataFrame, int]:
        """((feed_id, run) of what counts, the version): the last line of each feed, up to the last version there is now."""
        lines = stored(self.spark, "json", MANIFEST, f"{self.path}/manifest")
        last = lines.agg(F.max("version")).first()[0] or 0
        return lines.where(F.col("version") <= last).groupBy("feed_id").agg(F.max_by("run", "version").alias("run")), last

    def _rows(self, feeds: DataFrame) -> DataFrame:
        rows = stored(self.spark, self.form, self.schema, f"{self.path}/data")
        return rows.join(feeds, ["run", "feed_id"]).drop("run")  # on folders' names: Spark leaves the other folders out

    def read(self) -> DataFrame:
        """The rows as of now; runs that end later don't change them."""
        return self._rows(self._current()[0])

    def merge(self, rows: DataFrame, most_rows: int = 10_000) -> None:
        """Puts the rows in the place of those with the same key; the other rows of their feeds, and all other feeds, stay.

        Of rows that a run has twice the last by the text of its columns counts, so always the same.  No rows: nothing changes.
        """
        current, last = self._current()
        run = uuid.uuid4().hex
        with Staged(self.spark) as staged:
            rows = staged.save(rows, "merge")
            if rows.groupBy(*self.unique).count().where("count > 1").take(1):
                rows = staged.save(_newest(rows, self.unique), "merge")
            touched = rows.select("feed_id").distinct()
            old = self._rows(current.join(touched, "feed_id", "left_semi"))
            kept = self.keyed(old).join(self.keyed(rows).select(*self.key).distinct(), self.key, "left_anti").select(*old.columns)
            whole = kept.unionByName(rows.select(*old.columns)).hint("rebalance", "feed_id")  # large feeds are split over tasks
            whole.write.partitionBy("feed_id").option("maxRecordsPerFile", most_rows).option("compression", "gzip").format(self.form).save(f"{self.path}/data/run={run}")
            self._commit(touched, run, last + 1)

    def _commit(self, touched: DataFrame, run: str, version: int) -> None:
        """The one step that makes a run count: a single file, so it is there or not."""
        line = touched.select("feed_id", F.lit(run).alias("run"), F.lit(version).cast("long").alias("version"))
        line.coalesce(1).write.partitionBy("version").mode("append").json(f"{self.path}/manifest")

    def vacuum(self) -> int:
        """Empties the folders of runs of which no feed counts any more, and of those that were broken off; gives their number.

        For times when no run writes and nobody reads an older state.
        """
        live = self._current()[0].select("run").distinct()
        there = stored(self.spark, self.form, self.schema, f"{self.path}/data").select("run").distinct()
        gone = [r.run for r in there.join(live, "run", "left_anti").collect()]  # one row for each run since the last time
        for run in gone:
            empty(self.spark, f"{self.path}/data/run={run}")
        return len(gone)


def _newest(rows: DataFrame, unique: list[str | Column]) -> DataFrame:
    w = Window.partitionBy(*unique).orderBy(F.desc(F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

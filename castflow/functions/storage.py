"""Places for tables that are written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir or setCheckpointDir names it.

    A temporary one only where none is set and all runs in this one process (tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="castflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/castflow/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, form: str, schema: str, path: str) -> DataFrame:
    """The rows of the files at the path; none where nothing was written yet."""
    try:
        return spark.read.format(form).schema(schema).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def empty(spark: SparkSession, path: str) -> None:
    """Deletes the files of a folder, in the way that Spark offers: by writing no rows over them; with a partition column no file is left."""
    spark.createDataFrame([], "value string, part string").write.mode("overwrite").partitionBy("part").text(path)


class Staged:
    """Tables in the shared folder for the time of a with block; what comes from a model is computed once only."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, []

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, *_) -> None:
        for path in self._paths:
            empty(self.spark, path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        self._paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

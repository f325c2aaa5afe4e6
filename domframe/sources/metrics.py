"""A log of metrics by run, step and name, that a stream or a training can append to again without doubling anything."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, step bigint, name string, value double"


def append(rows: DataFrame, path: str, batch: str | int) -> None:
    """Adds rows(run, step, name, value) as one batch; a batch that is written again takes the place of its first writing."""
    rows.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stream(rows: DataFrame, path: str, checkpoint: str):
    """A started query that appends the stream rows(run, step, name, value), each micro-batch once, restarts included."""
    return rows.writeStream.foreachBatch(lambda df, k: append(df, path, f"s{k:09d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """run, step, name, value of all whole batches; of several values of one step the last batch's counts."""
    rows = spark.read.schema(f"{SCHEMA}, batch string").option("basePath", path).parquet(path)
    last = rows.groupBy("run", "step", "name").agg(F.max_by("value", "batch").alias("value"))
    return last.select("run", "step", "name", "value")


def compared(log: DataFrame, name: str, runs: list[str]) -> DataFrame:
    """step and a column for each of runs with its value of a metric; null where a run has no such step."""
    return log.where((F.col("name") == name) & F.col("run").isin(*runs)).groupBy("step").pivot("run", runs).agg(F.first("value"))


def logged(spark: SparkSession, run: str, log: list[tuple[str, int, float]]) -> DataFrame:
    """Rows of a training's log (name, step, value), as training.train() gives it."""
    return spark.createDataFrame([(run, step, name, float(value)) for name, step, value in log], SCHEMA)

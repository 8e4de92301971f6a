"""Structured Streaming forms of the operators; each gives what its batch form gives once all input has come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from terralens.io import ship_package
from terralens.sources.sinks import _fs


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A growing Parquet table (a folder or one file) as a stream with the schema of now; a trigger admits so many files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path if any(c in path for c in "*?[") else f"{path}*")


def daily_counts(stream: DataFrame, at: str, by: tuple[str, ...], late: str = "24 hours") -> DataFrame:
    """Counts by UTC-independent day windows and ``by``; records later than ``late`` behind the newest are dropped."""
    w = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return w.groupBy(F.window("_at", "1 day").alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), *by, "n")


def first_seen(stream: DataFrame, key: str, at: str, late: str = "24 hours") -> DataFrame:
    """Records whose key was not seen within the watermark: duplicates drop out, state stays bounded."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def sessions(stream: DataFrame, at: str, by: tuple[str, ...], gap: str = "24 hours", late: str = "24 hours") -> DataFrame:
    """Bursts by ``by``: a gap of ``gap`` closes one."""
    w = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return w.groupBy(F.session_window("_at", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("first"), F.col("w.end").alias("end"), "n")


HEALTH = "source_id int, failures int, empty int, status string, seen bigint"


def source_health(stream: DataFrame, degraded_at: int = 5, dead_at: int = 20) -> DataFrame:
    """Running state of each source over its polls ``source_id, ok, items``: consecutive failures and empty results.

    A success resets the failures, a result with items the empty count; the state after every trigger is emitted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, empty, seen = state.get if state.exists else (0, 0, 0)
        for pdf in batches:
            for ok, items in zip(pdf["ok"], pdf["items"]):
                failures = 0 if ok else failures + 1
                empty = empty + 1 if ok and not items else 0 if ok else empty
                seen += 1
        state.update((failures, empty, seen))
        status = "dead" if failures >= dead_at else "degraded" if failures >= degraded_at or empty >= degraded_at else "ok"
        yield pd.DataFrame({"source_id": [key[0]], "failures": [failures], "empty": [empty], "status": [status], "seen": [seen]})

    ship_package(stream.sparkSession)
    return stream.groupBy("source_id").applyInPandasWithState(step, HEALTH, "failures int, empty int, seen bigint", "update", "NoTimeout")


def run_once(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all input there is; its result, from files under ``folder`` (shared by all executors).

    In ``complete`` mode every trigger's result replaces the last, in ``append`` mode the triggers' results add up. A trigger
    that is run again after a failure writes the same numbered folder again.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/trigger={number:09d}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    files, path = _fs(spark, f"{folder}/out")
    if not files.exists(path):
        return spark.createDataFrame([], df.schema)
    out = spark.read.schema(StructType([*df.schema.fields, StructField("trigger", IntegerType())])).option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    if mode == "complete":
        last = out.agg(F.max("trigger")).first()[0]
        out = out.where(F.col("trigger") == last)
    return out.drop("trigger")


def each_batch(df: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch to ``do`` (idempotent by batch number), over all input there is."""
    df.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

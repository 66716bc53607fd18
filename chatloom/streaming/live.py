"""The stateful parts as Structured Streaming jobs.

Each function takes a streaming DataFrame of events and gives a streaming one; `run_once` drains what is there and returns the result
as a table, so the same job serves a backfill and, without the trigger, a live stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.session import scratch_path


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # as a pattern, so that a table of one file can be a source as well as a folder
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Drain the stream into a table of the shared folder: the last full result (complete), or all rows that came out (append, update)."""
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote before
        target = f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = stream.schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def tumbling_counts(events: DataFrame, span: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", span), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"
    )


def first_sightings(events: DataFrame) -> DataFrame:
    """Each user once, whenever first seen."""
    return events.filter(F.col("user_id").isNotNull()).dropDuplicates(["user_id"]).select("user_id")


def live_sessions(events: DataFrame, gap: str = "119 minutes 59 seconds", late: str = "3 hours") -> DataFrame:
    """Sessions by event time; a gap of two hours to the minute starts a new one."""
    minute = F.date_trunc("minute", "at")
    return events.withColumn("minute", minute).withWatermark("minute", late).groupBy(F.session_window("minute", gap), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"
    )


def running_totals(events: DataFrame) -> DataFrame:
    """Running count and value of each user, kept as state of our own across batches."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n += len(batch)
            total += float(batch["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(add, "user_id BIGINT, n BIGINT, total DOUBLE", "n BIGINT, total DOUBLE", "update", GroupStateTimeout.NoTimeout)

"""Streaming views of the event table: windowed counts, sessions, and a running profile per user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as a stream of Parquet files; the schema is taken from the table, not inferred per file."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and summed value per day and type; rows later than ``late`` are dropped from open windows."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("day"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no pause longer than ``gap``."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


PROFILE = "user_id long, n long, total double"


def running_profiles(events: DataFrame) -> DataFrame:
    """Each user's number of events and their summed value so far, kept in the state store."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n += len(f)
            total += float(f["value"].fillna(0.0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    rows = events.where("user_id is not null").select("user_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, PROFILE, "n long, total double", "update", GroupStateTimeout.NoTimeout)

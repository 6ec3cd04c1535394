"""Event queries, written so that the same plan runs on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.numeric import settled
from platewise.sources.tables import table
from platewise.streaming import events as E


def event_days(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and type."""
    d = E.daily_counts(table(spark, folder, "events", "ts", "event_type", "value"))
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", settled(F.col("value"), 3).alias("value"))


def weekend_split(spark: SparkSession, folder: str) -> DataFrame:
    """Events on weekdays and at weekends."""
    e = table(spark, folder, "events", "ts", "user_id")
    return e.groupBy((F.weekday("ts") >= 5).alias("weekend")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Number of sessions and events of each user, sessions split by 30 minutes of rest."""
    s = E.sessions(table(spark, folder, "events", "ts", "user_id"))
    return s.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


QUERIES = {f.__name__: f for f in (event_days, weekend_split, event_sessions)}
SQL = {
    "event_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, floor(sum(value)*1000e0+0.5e0)/1000e0 AS value FROM events GROUP BY 1, 2",
    "weekend_split": "SELECT isodow(ts) - 1 >= 5 AS weekend, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "event_sessions": """WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_ FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
        SELECT user_id, sum(new_)::BIGINT AS sessions, count(*) AS events FROM g GROUP BY 1""",
}

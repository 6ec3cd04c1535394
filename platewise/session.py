"""SparkSession factory with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

from platewise.runtime import ship


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI mode, adaptive execution, Arrow transfer and the package on its workers.

    ``master`` and ``shuffle_partitions`` stay with spark-submit unless given.
    """
    builder = SparkSession.builder.appName("platewise")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark

"""Dataset profiles: counts, exact quantiles, group sizes and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators import ranks as R

#: The shares at which distributions are described.
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: the number of rows and of rows that meet each condition (null counts as not met)."""
    return df.agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def quantiles(df: DataFrame, *columns: str, shares=QUANTILES) -> DataFrame:
    """``(column_name, share, value)`` by exact linear interpolation; all columns in one pass.

    A column without values gives nulls.
    """
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns))))
    found = R.quantiles(R.ranks(long, ["column_name"]), ["column_name"], shares)
    asked = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(float(s)).alias("share")) for c in columns for s in shares))
    return df.sparkSession.range(1).select(F.inline(asked)).join(found, ["column_name", "share"], "left").select("column_name", "share", "value")


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` for keys that are not null."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def tail(sizes: DataFrame, thresholds: tuple[int, ...], n: str = "n") -> DataFrame:
    """``(at_least, n_groups, rows_in_groups)``: groups of at least each size, in one aggregate."""
    aggregates = []
    for t in thresholds:
        aggregates += [F.count_if(F.col(n) >= t).alias(f"g{t}"), F.coalesce(F.sum(F.when(F.col(n) >= t, F.col(n))), F.lit(0)).alias(f"r{t}")]
    one = sizes.agg(*aggregates)
    entries = F.array(*(F.struct(F.lit(t).alias("at_least"), F.col(f"g{t}").alias("n_groups"), F.col(f"r{t}").alias("rows_in_groups")) for t in thresholds))
    return one.select(F.inline(entries))


def top(df: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with their counts, ties by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)

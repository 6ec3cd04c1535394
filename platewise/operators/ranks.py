"""Exact ranks of groups of any size: range-partitioned sorting with partition offsets.

Equal values are counted before they move, the distinct values are sorted by range
partitioning, every partition numbers its own rows, and the partitions' totals,
summed up in order, turn those numbers into ranks.  No task holds a whole group, and
a value that most rows share is one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.runtime import cut


def _parts(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranks(values: DataFrame, groups: list[str], value: str = "value", partitions: int | None = None) -> DataFrame:
    """``(*groups, value, same, below, total)``: a row per group and distinct value.

    ``same`` counts the rows with this value, ``below`` those with a lower one and
    ``total`` all of the group.  Null values are ignored; a null group is a group.
    """
    by = [*groups, value]
    counted = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("same"))
    ordered = counted.repartitionByRange(_parts(values, partitions), *by).sortWithinPartitions(*by)
    g = len(groups)

    def number(batches):
        from pyspark import TaskContext

        part, group, upto = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(i).to_pylist() for i in range(g)), strict=True)) if g else [()] * batch.num_rows
            same = batch.column(g + 1).to_numpy()
            before = np.empty(len(same), np.int64)
            starts = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(starts, starts[1:], strict=False):
                if names[a] != group:
                    group, upto = names[a], 0
                run = np.cumsum(same[a:b])
                before[a:b] = upto + run - same[a:b]
                upto += int(run[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.full(len(same), part, np.int32))], names=[*by, "same", "before", "part"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema)
    numbered = cut(ordered.mapInArrow(number, f"{kinds}, before long, part int"))
    totals = numbered.groupBy(*groups, "part").agg(F.sum("same").alias("n"))
    earlier = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per partition and group
    offsets = totals.select(
        *(F.col(x).alias(f"__{x}") for x in groups), F.col("part").alias("__part"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy(*groups)).alias("total"),
    )
    same_place = F.col("part") == F.col("__part")
    for x in groups:
        same_place = same_place & F.col(x).eqNullSafe(F.col(f"__{x}"))
    return numbered.join(offsets, same_place).select(*by, "same", (F.col("offset") + F.col("before")).alias("below"), "total")


def numbered(df: DataFrame, order: list[Column], rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's place, from 1, in the order of all rows; ``order`` must tell any two rows apart.

    The sorted rows are written once with their number inside their partition, which
    the partitions' sizes, a row each, then move up.
    """
    placed = cut(df.repartitionByRange(_parts(df, partitions), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"__part": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__offset"))
    # one row per partition of the sort
    return placed.join(F.broadcast(offsets), "__part").withColumn(rank, F.col("__offset") + F.col("__row") + 1).drop("__at", "__part", "__row", "__offset")


def quantiles(ranked: DataFrame, groups: list[str], shares, value: str = "value") -> DataFrame:
    """``(*groups, share, value)`` by exact linear interpolation over the rows of :func:`ranks`."""
    at = [(F.col("total") - 1) * F.lit(float(s)) for s in shares]

    def holds(place: Column) -> Column:
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("same")), F.col(value).cast("double")))

    found = ranked.groupBy(*groups).agg(*(F.struct(F.lit(float(s)).alias("share"), holds(F.floor(p)).alias("low"), holds(F.ceil(p)).alias("high"), F.max(p - F.floor(p)).alias("part")).alias(f"q{i}") for i, (s, p) in enumerate(zip(shares, at, strict=True))))
    rows = found.select(*groups, F.inline(F.array(*(F.col(f"q{i}") for i in range(len(shares))))))
    return rows.select(*groups, "share", F.when(F.col("part") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))

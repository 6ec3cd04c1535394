"""Readers and writers of the formats the engine exchanges, and a Markdown report of small tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_KINDS = {"LONG": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType()}


def _schema(columns: str) -> T.StructType:
    """A schema from ``name TYPE`` pairs, without a running session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


RECIPES = _schema(
    "name STRING, id LONG, minutes LONG, contributor_id LONG, submitted STRING, tags STRING, nutrition STRING, n_steps INT, steps STRING, description STRING, ingredients STRING, n_ingredients INT"
)
INTERACTIONS = _schema("user_id LONG, recipe_id LONG, date STRING, rating INT, review STRING")
MAPPING = _schema("raw_ingr STRING, replaced STRING")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *columns: str) -> DataFrame:
    """A CSV file with a header, quoted line breaks and doubled quotes; only ``columns`` are kept.

    The schema is stated, never inferred.  Rows that do not fit it come out with
    nulls; :mod:`platewise.operators.records` reports why instead.
    """
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, whole_file: bool = False) -> DataFrame:
    """JSON lines, or one value per file."""
    reader = spark.read.option("multiLine", whole_file)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet parts, optionally one folder per value of low-cardinality columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_pickled_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A pickled mapping table as a DataFrame; convert once and keep it as Parquet.

    Unpickling runs code from the file: read only files of your own.
    """
    import pandas as pd

    frame = pd.read_pickle(path)[["raw_ingr", "replaced"]]
    return spark.createDataFrame(list(frame.itertuples(index=False, name=None)), MAPPING)


def metrics_json(df: DataFrame, most: int = 10_000) -> str:
    """A small result as JSON text; refuses more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=1, default=str)


def markdown(title: str, df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; refuses more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"

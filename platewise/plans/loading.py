"""Queries that load packed and delimited text, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators.packed import RECIPE_FIELDS, explode_packed
from platewise.operators.records import loaded, parse_records, rejected
from platewise.sources.tables import table


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parse_records(table(spark, folder, "recipe_lines", "line_no", "raw_line"), "line_no", "raw_line")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(_parsed(spark, folder)).select("line_no", "reason")


def p2_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Failed records with the place of the fault."""
    return rejected(_parsed(spark, folder)).drop("offset")


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded records, typed."""
    return loaded(_parsed(spark, folder)).drop("offset")


def p2_text(spark: SparkSession, folder: str) -> DataFrame:
    """Records and faults per block of text: a file's lines joined by hundreds into texts of many records.

    After a broken quote the grammar resumes at the next record start, so a fault costs
    its own record.  Every line is in exactly one text.
    """
    lines = table(spark, folder, "recipe_lines", "line_no", "file_name", "raw_line").where("raw_line is not null")
    blocks = lines.groupBy("file_name", F.floor(F.col("line_no") / 100).alias("block")).agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw_line"))), lambda x: x["raw_line"]), "\n").alias("text")
    )
    parsed = parse_records(blocks.select("first_line", "text"), "first_line", "text", many=True)
    counted = parsed.groupBy("first_line").agg(F.count("*").alias("records"), *(F.count_if(F.col("reason") == r).alias(r) for r in ("quoting", "column_count", "nutrition", "ingredients")))
    return blocks.select("file_name", "first_line", "lines").join(counted, "first_line", "left")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return explode_packed(table(spark, folder, "recipes", "id", *RECIPE_FIELDS), "id", RECIPE_FIELDS)


def p4_field_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many values and different values each packed field holds over all recipes."""
    return p4_found(spark, folder).groupBy("field").agg(
        F.count("*").alias("n_values"), F.countDistinct("val").alias("n_distinct"), F.max("pos").cast("int").alias("last_pos")
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_errors, p2_loaded, p2_text, p4_found, p4_field_sizes)}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
SQL = {
    "p2_found": rf"""
WITH raw AS (SELECT line_no, coalesce(raw_line, '') AS t FROM recipe_lines),
split AS (
    SELECT line_no, regexp_full_match(t, '{_FIELD}(?:,{_FIELD})*', 's') AS quoted_well,
        regexp_full_match(t, '{_FIELD}(?:,{_FIELD}){{11}}', 's') AS twelve,
        regexp_extract(t, '^(?:{_FIELD},){{6}}({_FIELD})', 1, 's') AS f7,
        regexp_extract(t, '^(?:{_FIELD},){{10}}({_FIELD})', 1, 's') AS f11
    FROM raw),
plain AS (
    SELECT line_no, quoted_well, twelve,
        CASE WHEN starts_with(f7, '"') THEN replace(f7[2:-2], '""', '"') ELSE f7 END AS nutrition,
        CASE WHEN starts_with(f11, '"') THEN replace(f11[2:-2], '""', '"') ELSE f11 END AS ingredients
    FROM split),
judged AS (
    SELECT line_no, CASE WHEN NOT quoted_well THEN 'quoting' WHEN NOT twelve THEN 'column_count'
        WHEN NOT regexp_full_match(nutrition, '\s*\[\s*[0-9]+(\.[0-9]+)?(\s*,\s*[0-9]+(\.[0-9]+)?){{6}}\s*\]\s*') THEN 'nutrition'
        WHEN NOT regexp_full_match(ingredients, '\s*\[\s*(''([^''\\]|\\.)*''|"([^"\\]|\\.)*")(\s*,\s*(''([^''\\]|\\.)*''|"([^"\\]|\\.)*"))*\s*\]\s*', 's')
          OR regexp_matches(ingredients, '^\s*\[\s*(?:(?:''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*")\s*,\s*)*(?:''(?:\s|\\x20|\\xa0|\\t|\\n|\\r)*''|"(?:\s|\\x20|\\xa0|\\t|\\n|\\r)*")\s*[,\]]', 's') THEN 'ingredients'
        END AS reason FROM plain)
SELECT line_no, reason FROM judged WHERE reason IS NOT NULL
""",
}

"""Dataset profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.numeric import settled
from platewise.operators import profiling as P
from platewise.operators.packed import PHRASES, packed_values
from platewise.sources.tables import table

#: The group sizes that are reported.
TAILS = (1, 2, 3, 5, 10, 15, 20, 25, 30, 50, 100)


def prof_counts(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "recipes", "id", "name", "description", "nutrition", "minutes", "n_steps", "submitted")
    return P.counts(
        r, null_names=F.col("name").isNull(), null_descriptions=F.col("description").isNull(), null_nutrition=F.col("nutrition").isNull(),
        null_dates=F.col("submitted").isNull(), no_minutes=F.col("minutes") == 0, long_minutes=F.col("minutes") > 1440, no_steps=F.col("n_steps") < 1,
    )


def prof_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users, items and pairs of the interactions."""
    return table(spark, folder, "interactions", "user_id", "recipe_id").agg(
        F.countDistinct("user_id").alias("n_users"), F.countDistinct("recipe_id").alias("n_items"), F.countDistinct("user_id", "recipe_id").alias("n_pairs")
    )


def prof_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    names = ("minutes", "calories", "n_steps", "n_ingredients")
    return P.quantiles(table(spark, folder, "corpus", *names), *names).withColumn("value", settled(F.col("value")))


def prof_moments(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "corpus", "calories", "minutes")
    one = c.agg(*(x for n in ("calories", "minutes") for x in (settled(F.avg(n), 2).alias(f"avg_{n}"), F.max(n).alias(f"max_{n}"))))
    middle = P.quantiles(c, "calories", "minutes", shares=(0.5,))
    medians = middle.agg(*(F.max(F.when(F.col("column_name") == n, F.col("value"))).alias(f"median_{n}") for n in ("calories", "minutes")))
    # one row with one row
    return one.join(F.broadcast(medians)).select(*(f"{x}_{n}" for n in ("calories", "minutes") for x in ("avg", "median", "max")))


def prof_hist(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "interactions", "rating").groupBy("rating").agg(F.count("*").alias("n"))


def prof_top_tags(spark: SparkSession, folder: str) -> DataFrame:
    tags = packed_values(table(spark, folder, "recipes", "id", "tags"), "id", {"tags": PHRASES})
    return P.top(tags.select("id", F.col("val").alias("tag")), "tag", 40)


def prof_top_ingredients(spark: SparkSession, folder: str) -> DataFrame:
    return P.top(table(spark, folder, "corpus", "ingredients_norm").select(F.explode("ingredients_norm").alias("item")), "item", 40)


def prof_match_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Share of distinct and of all entered strings that the map or its canonical list knows."""
    used = table(spark, folder, "corpus", "ingredients").select(F.explode("ingredients").alias("item")).select(F.lower(F.trim("item")).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    m = table(spark, folder, "ingr_map").where("replaced is not null")
    known = m.select(F.lower("raw_ingr").alias("item")).union(m.select(F.lower("replaced"))).distinct().withColumn("known", F.lit(1))
    found = used.where("item is not null").join(known, "item", "left")
    return found.agg(
        F.count("*").alias("n_distinct"), F.count("known").alias("known_distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"),
        F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("known_all"),
    )


def prof_user_tail(spark: SparkSession, folder: str) -> DataFrame:
    return P.tail(P.group_sizes(table(spark, folder, "interactions", "user_id"), "user_id"), TAILS)


def prof_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of interactions per user and per item."""
    i = table(spark, folder, "interactions", "user_id", "recipe_id")
    sizes = [P.quantiles(P.group_sizes(i, k).withColumnRenamed("n", k + "_size"), k + "_size") for k in ("user_id", "recipe_id")]
    return sizes[0].unionByName(sizes[1])


def prof_density(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "interactions", "user_id", "recipe_id").where("user_id is not null and recipe_id is not null")
    one = i.agg(F.countDistinct("user_id", "recipe_id").alias("n"), F.countDistinct("user_id").alias("u"), F.countDistinct("recipe_id").alias("i"))
    cells = F.col("u").cast("double") * F.col("i")
    return one.select("n", settled(F.try_divide(F.col("n") * 1e6, cells), 2).alias("per_million_cells"))


QUERIES = {
    f.__name__: f
    for f in (
        prof_counts, prof_distinct, prof_quantiles, prof_moments, prof_hist, prof_top_tags, prof_top_ingredients, prof_match_rate,
        prof_user_tail, prof_group_sizes, prof_density,
    )
}

#: tags of a row in SQL: no tag holds a delimiter or a quote, so splitting and trimming is exact
TAGS_SQL = r"""
tag_rows AS (SELECT id, unnest(string_split_regex(tags, '[,;|\t\r\n]')) AS v FROM recipes
    WHERE tags IS NOT NULL AND NOT (starts_with(tags, '[') AND NOT ends_with(rtrim(tags), ']'))),
tag_set AS (SELECT DISTINCT id, t AS tag FROM (SELECT id, trim(regexp_replace(v, '[\[\]"'']', '', 'g')) AS t FROM tag_rows) WHERE t <> '')
"""
_SHARES = "unnest([0.01e0,0.05e0,0.25e0,0.5e0,0.75e0,0.95e0,0.99e0])"


def _quantile_sql(source: str, *columns: str, value: str = "value") -> str:
    one = "SELECT '{c}' AS column_name, share, {v} AS value FROM (SELECT " + _SHARES + " AS share, unnest(q) AS value FROM (SELECT quantile_cont({c}::DOUBLE, [0.01,0.05,0.25,0.5,0.75,0.95,0.99]) AS q FROM {s}))"
    return " UNION ALL ".join(one.format(c=c, s=source, v=value) for c in columns)


_TAIL = ", ".join(f"({t})" for t in TAILS)
SQL = {
    "prof_counts": """SELECT count(*) AS n_rows, count(*) FILTER (name IS NULL) AS null_names, count(*) FILTER (description IS NULL) AS null_descriptions,
        count(*) FILTER (nutrition IS NULL) AS null_nutrition, count(*) FILTER (submitted IS NULL) AS null_dates, count(*) FILTER (minutes = 0) AS no_minutes,
        count(*) FILTER (minutes > 1440) AS long_minutes, count(*) FILTER (n_steps < 1) AS no_steps FROM recipes""",
    "prof_distinct": """SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT recipe_id) AS n_items,
        (SELECT count(*) FROM (SELECT DISTINCT user_id, recipe_id FROM interactions WHERE user_id IS NOT NULL AND recipe_id IS NOT NULL)) AS n_pairs FROM interactions""",
    "prof_quantiles": _quantile_sql("corpus", "minutes", "calories", "n_steps", "n_ingredients", value="floor(value*10000+0.5e0)/10000"),
    "prof_moments": """SELECT floor(avg(calories)*100+0.5e0)/100 AS avg_calories, median(calories) AS median_calories, max(calories) AS max_calories,
        floor(avg(minutes)*100+0.5e0)/100 AS avg_minutes, median(minutes::DOUBLE) AS median_minutes, max(minutes) AS max_minutes FROM corpus""",
    "prof_hist": "SELECT rating, count(*) AS n FROM interactions GROUP BY rating",
    "prof_top_tags": "WITH " + TAGS_SQL + "SELECT tag, count(*) AS n FROM tag_set GROUP BY tag ORDER BY n DESC, tag LIMIT 40",
    "prof_top_ingredients": "SELECT item, count(*) AS n FROM (SELECT unnest(ingredients_norm) AS item FROM corpus) GROUP BY item ORDER BY n DESC, item LIMIT 40",
    "prof_match_rate": """WITH used AS (SELECT lower(trim(i)) AS item, count(*) AS n FROM (SELECT unnest(ingredients) AS i FROM corpus) WHERE i IS NOT NULL GROUP BY 1),
        known AS (SELECT lower(raw_ingr) AS item FROM ingr_map WHERE replaced IS NOT NULL UNION SELECT lower(replaced) FROM ingr_map WHERE replaced IS NOT NULL)
        SELECT count(*) AS n_distinct, count(*) FILTER (item IN (SELECT item FROM known WHERE item IS NOT NULL)) AS known_distinct, sum(n)::BIGINT AS n_all,
        coalesce(sum(n) FILTER (item IN (SELECT item FROM known WHERE item IS NOT NULL)), 0)::BIGINT AS known_all FROM used""",
    "prof_user_tail": f"""WITH s AS (SELECT user_id, count(*) AS n FROM interactions WHERE user_id IS NOT NULL GROUP BY 1)
        SELECT at_least, count(s.n) AS n_groups, coalesce(sum(s.n), 0)::BIGINT AS rows_in_groups
        FROM (VALUES {_TAIL}) v(at_least) LEFT JOIN s ON s.n >= at_least GROUP BY 1""",
    "prof_group_sizes": _quantile_sql("(SELECT count(*) AS user_id_size FROM interactions WHERE user_id IS NOT NULL GROUP BY user_id)", "user_id_size")
    + " UNION ALL " + _quantile_sql("(SELECT count(*) AS recipe_id_size FROM interactions WHERE recipe_id IS NOT NULL GROUP BY recipe_id)", "recipe_id_size"),
    "prof_density": """WITH i AS (SELECT DISTINCT user_id, recipe_id FROM interactions WHERE user_id IS NOT NULL AND recipe_id IS NOT NULL)
        SELECT count(*) AS n, floor(count(*)*1e6/(count(DISTINCT user_id)::DOUBLE * count(DISTINCT recipe_id))*100+0.5e0)/100 AS per_million_cells FROM i""",
}

"""Queries that clean the raw items and derive the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators import cleaning as C
from platewise.operators.packed import PHRASES, packed_values
from platewise.plans.profiling import TAGS_SQL
from platewise.sources.tables import table


def _items(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "recipes", "id", "name", "minutes", "n_steps", "n_ingredients", "tags", "nutrition")
    return C.with_slots(C.with_nutrition(C.with_tags(raw)))


def parse_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of each raw item, once each."""
    return packed_values(table(spark, folder, "recipes", "id", "tags"), "id", {"tags": PHRASES}).select("id", F.col("val").alias("tag"))


def nutrition_columns(spark: SparkSession, folder: str) -> DataFrame:
    return C.with_nutrition(table(spark, folder, "recipes", "id", "nutrition")).drop("nutrition").distinct()


def cleaning_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    return C.waterfall(_items(spark, folder), C.item_rules())


def first_broken_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Items by the rule that rejects them; null for the retained."""
    return _items(spark, folder).groupBy(C.first_rule(C.item_rules()).alias("rule")).agg(F.count("*").alias("n"))


def retained_items(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the items that break no rule."""
    return _items(spark, folder).where(C.first_rule(C.item_rules()).isNull()).select("id").distinct()


def side_pool(spark: SparkSession, folder: str) -> DataFrame:
    return C.side_pool(_items(spark, folder)).select("id", "side_breakfast").distinct()


def slot_counts(spark: SparkSession, folder: str) -> DataFrame:
    flags = ("in_breakfast", "in_lunch", "in_dinner", "excluded", "side_tagged")
    return _items(spark, folder).agg(*(F.count_if(F.col(f)).alias(f) for f in flags))


def normalise_residue(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical ingredients of each corpus row, and whether any string stayed unresolved."""
    corpus = table(spark, folder, "corpus", "id", "ingredients")
    return C.normalise(corpus, "id", "ingredients", table(spark, folder, "ingr_map")).select("id", F.array_join("norm", "|").alias("norm"), "has_unmappable")


def doc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of each corpus row: canonical ingredients with spaces closed up, then the tags."""
    corpus = table(spark, folder, "corpus", "id", "ingredients_norm")
    terms = corpus.select("id", F.explode("ingredients_norm").alias("i")).select("id", F.replace("i", F.lit(" "), F.lit("_")).alias("token"))
    tags = parse_lists(spark, folder).join(corpus.select("id"), "id", "left_semi")
    return terms.where("token is not null").unionByName(tags.withColumnRenamed("tag", "token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def interactions_semijoin(spark: SparkSession, folder: str) -> DataFrame:
    mains = table(spark, folder, "corpus", "id", "is_side").where("not is_side")
    kept = table(spark, folder, "interactions", "user_id", "recipe_id", "rating").join(mains, F.col("recipe_id") == F.col("id"), "left_semi")
    return kept.groupBy("recipe_id").agg(F.count("*").alias("n"), F.count("rating").alias("n_rated"))


def interactions_outside(spark: SparkSession, folder: str) -> DataFrame:
    """Interactions with items outside the corpus."""
    ids = table(spark, folder, "corpus", "id")
    return table(spark, folder, "interactions", "recipe_id").join(ids, F.col("recipe_id") == F.col("id"), "left_anti").groupBy("recipe_id").agg(F.count("*").alias("n"))


def recipe_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus rows with their descriptions, an empty text where there is none."""
    prose = table(spark, folder, "recipes", "id", "description").groupBy("id").agg(F.min("description").alias("d"))
    return table(spark, folder, "corpus", "id", "name").join(prose, "id", "left").select("id", "name", F.coalesce("d", F.lit("")).alias("description"))


def mains_first(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus with mains before sides; order is a property of the key, never of the position."""
    return table(spark, folder, "corpus", "id", "is_side").orderBy("is_side", "id")


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "corpus", "is_side", "is_breakfast", "is_lunch", "is_dinner", "has_unmappable")
    one = c.agg(
        F.count("*").alias("rows"), F.count_if(~F.col("is_side")).alias("mains"), F.count_if("is_side").alias("sides"),
        F.count_if(F.col("is_side") & (F.col("is_breakfast") | F.col("is_lunch") | F.col("is_dinner"))).alias("sides in a slot"),
        F.count_if("has_unmappable").alias("unmappable"),
    )
    return one.unpivot([], one.columns, "label", "value")


def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Stored totals against totals derived anew: sides are mains' complement and in no slot."""
    c = table(spark, folder, "corpus", "id", "is_side", "ingredients", "has_unmappable")
    anew = C.normalise(c, "id", "ingredients", table(spark, folder, "ingr_map"))
    one = c.agg(F.count("*").alias("rows"), (F.count("*") - F.count_if("is_side")).alias("mains"), F.count_if("is_side").alias("sides"))
    expected = one.unpivot([], one.columns, "label", "value")
    expected = expected.unionByName(anew.agg(F.count_if("has_unmappable").alias("value")).select(F.lit("unmappable").alias("label"), "value"))
    expected = expected.unionByName(spark.createDataFrame([("sides in a slot", 0)], "label string, value long"))
    return C.reconcile(_totals(spark, folder), expected)


QUERIES = {
    f.__name__: f
    for f in (
        parse_lists, nutrition_columns, cleaning_waterfall, first_broken_rule, retained_items, side_pool, slot_counts, normalise_residue, doc_tokens,
        interactions_semijoin, interactions_outside, recipe_detail, mains_first, reconcile,
    )
}


def _tag(tags: tuple[str, ...]) -> str:
    """SQL of whether a packed field holds one of ``tags`` as a whole value."""
    words = "|".join(tags)
    return rf"(tags IS NOT NULL AND NOT (starts_with(tags, '[') AND NOT ends_with(rtrim(tags), ']')) AND regexp_matches(tags, '(^\[?|[,;|\t\r\n])\s*[''\"]?({words})[''\"]?\s*($|[,;|\t\r\n\]])'))".replace('\\"', '"')


_NUMBERS = r"CASE WHEN nutrition IS NULL OR (starts_with(nutrition, '[') AND NOT ends_with(rtrim(nutrition), ']')) THEN [] ELSE regexp_extract_all(nutrition, '[^][(),;|/\s''\"]+') END".replace('\\"', '"')
ITEMS_SQL = f"""
WITH numbered AS (SELECT *, {_NUMBERS} AS ns FROM recipes),
items AS (
    SELECT id, name, minutes, n_steps, n_ingredients, {", ".join(f"{_tag(t)} AS in_{s}" for s, t in C.SLOT_TAGS.items())},
        {_tag(C.EXCLUDED_TAGS)} AS excluded, {_tag(C.SIDE_TAGS)} AS side_tagged, {_tag(C.SIDE_BREAKFAST_TAGS)} AS side_breakfast,
        CASE WHEN len(ns) = 7 THEN try_cast(ns[1] AS DOUBLE) END AS calories, ns FROM numbered),
ruled AS (
    SELECT *, name IS NULL AS r1, calories IS NULL AS r2, coalesce(calories = 0, false) AS r3, coalesce(calories > 2000, false) AS r4,
        coalesce(minutes = 0, false) AS r5, coalesce(minutes > 1440, false) AS r6, coalesce(n_ingredients < 2, false) AS r7,
        coalesce(n_steps < 1, false) AS r8, NOT ((in_breakfast OR in_lunch OR in_dinner) AND NOT excluded) AS r9 FROM items)
"""
_NAMES = [n for n, _ in (("missing name", 0), ("malformed nutrition", 0), ("no calories", 0), ("calories over 2000", 0), ("no minutes", 0), ("minutes over 1440", 0), ("fewer than 2 ingredients", 0), ("no steps", 0), ("no slot", 0))]
_FIRST = "CASE " + " ".join(f"WHEN r{i + 1} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
_KNOWN = """known AS (SELECT k, arg_min(v, (o, v)) AS v FROM (
    SELECT lower(raw_ingr) AS k, lower(replaced) AS v, 0 AS o FROM ingr_map WHERE replaced IS NOT NULL
    UNION ALL SELECT lower(replaced), lower(replaced), 1 FROM ingr_map WHERE replaced IS NOT NULL) WHERE k IS NOT NULL GROUP BY k),
lines AS (SELECT id, unnest(ingredients) AS item, generate_subscripts(ingredients, 1) AS pos FROM corpus),
looked AS (SELECT id, pos, coalesce(v, lower(trim(item))) AS x, v IS NULL AS missing FROM lines LEFT JOIN known ON k = lower(trim(item)) WHERE item IS NOT NULL),
anew AS (SELECT c.id, coalesce(string_agg(x, '|' ORDER BY pos), '') AS norm, coalesce(bool_or(missing), false) AS has_unmappable FROM corpus c LEFT JOIN looked l ON c.id = l.id GROUP BY c.id)
"""
SQL = {
    "parse_lists": "WITH " + TAGS_SQL + "SELECT id, tag FROM tag_set",
    "nutrition_columns": ITEMS_SQL + "SELECT DISTINCT id, calories, " + ", ".join(
        f"CASE WHEN len(ns) = 7 THEN try_cast(ns[{C.NUTRIENTS.index(n.rsplit('_', 1)[0]) + 1}] AS DOUBLE) END / 100.0e0 * {v}e0 AS {n}" for n, v in C.DAILY_VALUE.items()
    ) + " FROM items",
    "cleaning_waterfall": ITEMS_SQL + " UNION ALL ".join(
        f"SELECT {i + 1} AS rule_no, '{n}' AS rule, count(*) FILTER (r{i + 1}) AS matched, count(*) FILTER (r{i + 1} AND NOT ({' OR '.join(['false', *(f'r{j + 1}' for j in range(i))])})) AS newly FROM ruled" for i, n in enumerate(_NAMES)
    ),
    "first_broken_rule": ITEMS_SQL + f"SELECT {_FIRST} AS rule, count(*) AS n FROM ruled GROUP BY 1",
    "retained_items": ITEMS_SQL + f"SELECT DISTINCT id FROM ruled WHERE {_FIRST} IS NULL",
    "side_pool": ITEMS_SQL + "SELECT DISTINCT id, side_breakfast FROM ruled WHERE NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7 OR r8) AND r9 AND side_tagged AND NOT excluded",
    "slot_counts": ITEMS_SQL + "SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in ("in_breakfast", "in_lunch", "in_dinner", "excluded", "side_tagged")) + " FROM items",
    "normalise_residue": "WITH " + _KNOWN + "SELECT * FROM anew",
    "doc_tokens": "WITH " + TAGS_SQL + """, both_ AS (SELECT id, replace(i, ' ', '_') AS token FROM (SELECT id, unnest(ingredients_norm) AS i FROM corpus) WHERE i IS NOT NULL
        UNION ALL SELECT id, tag FROM tag_set WHERE id IN (SELECT id FROM corpus)) SELECT id, token, count(*) AS tf FROM both_ GROUP BY 1, 2""",
    "interactions_semijoin": "SELECT recipe_id, count(*) AS n, count(rating) AS n_rated FROM interactions WHERE recipe_id IN (SELECT id FROM corpus WHERE NOT is_side) GROUP BY 1",
    "interactions_outside": "SELECT recipe_id, count(*) AS n FROM interactions i WHERE NOT EXISTS (SELECT 1 FROM corpus c WHERE c.id = i.recipe_id) GROUP BY 1",
    "recipe_detail": "SELECT c.id, c.name, coalesce(d, '') AS description FROM corpus c LEFT JOIN (SELECT id, min(description) AS d FROM recipes GROUP BY id) r ON r.id = c.id",
    "mains_first": "SELECT id, is_side FROM corpus",
    "reconcile": "WITH " + _KNOWN + """, a AS (
        SELECT 'rows' AS label, count(*) AS actual, count(*) AS expected FROM corpus
        UNION ALL SELECT 'mains', count(*) FILTER (NOT is_side), count(*) - count(*) FILTER (is_side) FROM corpus
        UNION ALL SELECT 'sides', count(*) FILTER (is_side), count(*) FILTER (is_side) FROM corpus
        UNION ALL SELECT 'sides in a slot', count(*) FILTER (is_side AND (is_breakfast OR is_lunch OR is_dinner)), 0 FROM corpus
        UNION ALL SELECT 'unmappable', (SELECT count(*) FILTER (has_unmappable) FROM corpus), count(*) FILTER (has_unmappable) FROM anew)
        SELECT label, actual, expected, actual = expected AS agrees FROM a""",
}

"""Views shared by the scoring, recommendation and planning queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import nutrition as N
from platewise.sources.tables import table

#: twelve profiles made by rule, all attributes from the profile's number
PROFILES = [
    {
        "profile_id": k, "male": k % 2 == 1, "age": 20.0 + k * 7 % 45, "height_cm": 150.0 + k * 11 % 40, "weight_kg": 50.0 + k * 13 % 45,
        "activity": (1.4, 1.6, 1.75, 1.9)[k % 4], "max_sodium": 800.0 if k % 5 == 0 else None, "max_sugar": 15.0 if k % 6 == 0 else None,
        "avoid": ("", "egg", "nut", "")[k % 4], "banned": ("", "oats", "olives")[k % 3], "regime": ("", "vegetarian", "third", "", "vegan")[k % 5], "weekday_minutes": 30, "weekend_minutes": 75,
    }
    for k in range(1, 13)
]
_KINDS = {"profile_id": "int", "male": "boolean", "avoid": "string", "banned": "string", "regime": "string", "weekday_minutes": "int", "weekend_minutes": "int"}


def profile_structs(profiles: list[dict] = PROFILES) -> Column:
    """The profiles as one literal array: a stated query set, inlined into every row instead of a join."""
    return F.array(*(F.struct(*(F.lit(v).cast(_KINDS.get(k, "double")).alias(k) for k, v in p.items())) for p in profiles))


def for_profiles(items: DataFrame, profiles: list[dict] = PROFILES) -> DataFrame:
    """Each item once per profile of a block."""
    return items.select("*", F.inline(profile_structs(profiles)))


def daily() -> dict[str, Column]:
    """Daily targets of the profile columns."""
    rate = N.basal_rate(F.col("weight_kg"), F.col("height_cm"), F.col("age"), F.col("male"))
    return N.daily_targets(rate, F.col("activity"), F.col("weight_kg"))


def taste(seed: int = 104729) -> Column:
    """A stand-in relevance in [0, 1) by arithmetic on item and profile."""
    return ((F.col("id") * 7919 + F.col("profile_id") * seed) % 1000).cast("double") / 1000.0


def items(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Corpus rows with nutrition and minutes."""
    return table(spark, folder, "corpus", "id", "minutes", *N.NUTRIENTS, *more).where(" and ".join(f"{n} is not null" for n in N.NUTRIENTS))


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """``(user, id, rating)``: the latest rating of each user and item, ties by load time and rating.

    The latest is found by a maximum, which is combined before the shuffle.
    """
    rows = table(spark, folder, "interactions", "user_id", "recipe_id", "rating", "rated_at", "loaded_at").where("user_id is not null and recipe_id is not null and rating is not null")
    latest = rows.groupBy(F.col("user_id").alias("user"), F.col("recipe_id").alias("id")).agg(F.max(F.struct("rated_at", "loaded_at", "rating"))["rating"].alias("rating"))
    return latest


PROFILES_SQL = """
prof AS (SELECT k::INTEGER AS profile_id, k % 2 = 1 AS male, (20 + (k * 7) % 45)::DOUBLE AS age, (150 + (k * 11) % 40)::DOUBLE AS height_cm, (50 + (k * 13) % 45)::DOUBLE AS weight_kg,
    CASE k % 4 WHEN 0 THEN 1.4e0 WHEN 1 THEN 1.6e0 WHEN 2 THEN 1.75e0 ELSE 1.9e0 END AS activity, CASE WHEN k % 5 = 0 THEN 800e0 END AS max_sodium, CASE WHEN k % 6 = 0 THEN 15e0 END AS max_sugar,
    CASE k % 4 WHEN 1 THEN 'egg' WHEN 2 THEN 'nut' ELSE '' END AS avoid, CASE k % 3 WHEN 1 THEN 'oats' WHEN 2 THEN 'olives' ELSE '' END AS banned,
    CASE k % 5 WHEN 1 THEN 'vegetarian' WHEN 2 THEN 'third' WHEN 4 THEN 'vegan' ELSE '' END AS regime FROM range(1, 13) r(k)),
rated AS (SELECT *, weight_kg * 10e0 + height_cm * 6.25e0 - age * 5e0 + CASE WHEN male THEN 5e0 ELSE -161e0 END AS rate FROM prof),
daily AS (SELECT *, rate * activity AS d_calories, weight_kg * 0.75e0 AS d_protein_g, rate * activity * 0.50e0 / 4e0 AS d_carbs_g, rate * activity * 0.35e0 / 9e0 AS d_fat_g,
    rate * activity * 0.11e0 / 9e0 AS d_satfat_g, rate * activity * 0.05e0 / 4e0 AS d_sugar_g, 2400e0 AS d_sodium_mg FROM rated)
"""
ITEMS_SQL = "items AS (SELECT * FROM corpus WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in N.NUTRIENTS) + ")"
RATINGS_SQL = """
ratings AS (SELECT user_id AS "user", recipe_id AS id, rating FROM interactions WHERE user_id IS NOT NULL AND recipe_id IS NOT NULL AND rating IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY user_id, recipe_id ORDER BY rated_at DESC, loaded_at DESC, rating DESC) = 1)
"""


def settled_sql(expression: str, digits: int = 4) -> str:
    scale = 10**digits
    return f"floor(({expression})*{scale}e0+0.5e0)/{scale}e0"

"""Planning queries: whole plans by the planner, and operators over a fixed plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.functions import nutrition as N
from platewise.functions.numeric import settled
from platewise.operators import content, planner, ranking, ranks
from platewise.operators.cleaning import SIDE_BREAKFAST_TAGS, first_rule
from platewise.operators.lexicon import joined_text
from platewise.plans import common as C
from platewise.plans import recommend, scoring
from platewise.plans.cleaning import parse_lists
from platewise.plans.scoring import SCORED_SQL, _admitted_sql, _penalty_sql, _servings_sql
from platewise.plans.text import SAMPLE, _fires
from platewise.runtime import cut
from platewise.sources.tables import table

#: Words of ingredients that a kitchen keeps.
PANTRY = (
    "oil", "salt", "pepper", "water", "sugar", "flour", "butter",
    "vinegar", "stock", "broth", "sauce", "spray", "yeast", "baking",
    "vanilla", "cornstarch", "honey", "syrup", "wine", "seasoning",
)


def relevance(spark: SparkSession, folder: str, profiles: list[dict]) -> DataFrame:
    """``(profile_id, id, relevance)``: cosine of items with the taste of the user whose ratings a profile has.

    The n-th profile has those of the n-th most active user.
    """
    rated = C.ratings(spark, folder)
    most = ranks.numbered(rated.groupBy("user").agg(F.count("*").alias("n")), [F.desc("n"), F.col("user")], "profile_id")
    owners = cut(most.where(F.col("profile_id").isin([p["profile_id"] for p in profiles])).select("user", F.col("profile_id").cast("int").alias("profile_id")))
    weights = cut(recommend._weights(spark, folder))
    vectors = cut(content.user_vectors(weights, rated.join(F.broadcast(owners), "user").select("user", "id", "rating")))  # a row per profile
    return content.cosine(weights, vectors).join(F.broadcast(owners), "user").select("profile_id", "id", settled(F.col("score"), 6).alias("relevance"))


def pool(spark: SparkSession, folder: str, profiles: list[dict] = C.PROFILES) -> DataFrame:
    """Items that pass the hard filter of each profile, with relevance, slots and ingredients."""
    sides = parse_lists(spark, folder).where(F.col("tag").isin(*SIDE_BREAKFAST_TAGS)).select("id").distinct().withColumn("side_breakfast", F.lit(True))
    base = C.items(spark, folder, "is_side", "has_unmappable", "ingredients", "is_breakfast", "is_lunch", "is_dinner")
    base = scoring.flagged(base, spark, folder)
    base = base.join(scoring.vocabulary_items(spark, folder), "id", "left").join(sides, "id", "left")
    rows = C.for_profiles(base, profiles).join(relevance(spark, folder, profiles), ["profile_id", "id"], "left")
    return rows.where(first_rule(scoring.profile_rules(profiles)).isNull()).select(
        "profile_id", "id", *N.NUTRIENTS, "minutes", "is_side", F.coalesce("side_breakfast", F.lit(False)).alias("side_breakfast"),
        *(F.col(f"is_{s}").alias(f"in_{s}") for s in planner.SLOTS), F.coalesce("ingr", F.array().cast("array<string>")).alias("ingr"), F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
    )


def plan_week(spark: SparkSession, folder: str) -> DataFrame:
    """A week for all twelve profiles: mains, sides and relaxation."""
    profiles = C.PROFILES
    return planner.as_table(spark, planner.Planner(cut(pool(spark, folder, profiles)), profiles).week()).drop("ingr")


def plan_locked(spark: SparkSession, folder: str) -> DataFrame:
    """One day planned around its lunch, which was chosen first."""
    candidates = cut(pool(spark, folder))
    first = planner.Planner(candidates, C.PROFILES)
    first.fill(0, "lunch")
    later = planner.Planner(candidates, C.PROFILES, locked=first.plan())
    return planner.as_table(spark, later.week(1)).drop("ingr")


def plan_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """The planner's own two days by profile: energy reached, days within all ceilings, dissimilarity of the mains, and meals that break a rule."""
    candidates = cut(pool(spark, folder))
    plan = cut(planner.as_table(spark, planner.Planner(candidates, C.PROFILES).week(2)))
    d = _with_daily(planner.days(plan))
    met = F.lit(True)
    for n in N.CEILINGS:
        met = met & (F.col(n) <= F.col(f"d_{n}"))
    reach = d.groupBy("profile_id").agg(settled(F.avg(F.col("calories") / F.col("d_calories") * 100.0), 2).alias("reach_calories"), F.count_if(met).alias("days_met"))
    mains = plan.where("role = 'main'").withColumn("at", F.concat_ws("-", "day", "slot"))
    unlike = ranking.dissimilarity(mains, "profile_id", "ingr", "at").select("profile_id", settled(F.col("ild")).alias("ild"))
    broken = plan.join(scoring._filtered(spark, folder).where("failed is not null").select("profile_id", "id", "failed"), ["profile_id", "id"])
    return reach.join(unlike, "profile_id", "left").join(broken.groupBy("profile_id").agg(F.count("*").alias("violations")), "profile_id", "left").na.fill(0, ["violations"])


def plan_relax(spark: SparkSession, folder: str) -> DataFrame:
    """One breakfast at each level of relaxation."""
    profiles = C.PROFILES
    rows, candidates = [], cut(pool(spark, folder, profiles))
    for level in range(5):
        p = planner.Planner(candidates, profiles)
        p.fill(0, "breakfast", level)
        rows += p.plan()
    return planner.as_table(spark, rows).drop("ingr")


def fixed_plan(spark: SparkSession, folder: str) -> DataFrame:
    """A plan by arithmetic: seven mains per profile and slot, one side per plate."""
    items = C.items(spark, folder, "is_side", "is_breakfast", "is_lunch", "is_dinner", "ingredients_norm", "ingredients", "has_unmappable")
    text = joined_text("ingredients")
    found = F.array_compact(F.array(*(F.when(SAMPLE.fires(text, c), F.lit(c)) for c in SAMPLE.classes)))
    items = items.withColumn("classes", found).drop("ingredients")
    slots = F.array_compact(F.array(*(F.when(F.col(f"is_{s}") & ~F.col("is_side"), F.lit(s)) for s in planner.SLOTS), F.when(F.col("is_side"), F.lit("side"))))
    rows = C.for_profiles(items.withColumn("slot", F.explode(slots)).drop("is_side", "is_breakfast", "is_lunch", "is_dinner"))
    rows = rows.withColumn("key", (F.col("id") * 7919 + F.col("profile_id") * 104729) % 100003)
    rows = content.top_k(rows, ["profile_id", "slot"], [F.col("key"), F.col("id")], 21).where((F.col("slot") == "side") | (F.col("rn") <= 7))
    side = F.col("slot") == "side"
    place = F.element_at(F.array(*map(F.lit, planner.SLOTS)), ((F.col("rn") - 1) % 3 + 1).cast("int"))
    return rows.select(
        "profile_id", F.when(side, F.floor((F.col("rn") - 1) / 3)).otherwise(F.col("rn") - 1).cast("int").alias("day"), F.when(side, place).otherwise(F.col("slot")).alias("slot"),
        F.when(side, F.lit("side")).otherwise(F.lit("main")).alias("role"), "id", (0.5 + 0.5 * ((F.col("id") + F.col("profile_id")) % 3)).alias("servings"),
        *N.NUTRIENTS, "minutes", F.coalesce("ingredients_norm", F.array().cast("array<string>")).alias("ingr"), "classes", "has_unmappable",
    )


def plate_totals(spark: SparkSession, folder: str) -> DataFrame:
    p = planner.plates(fixed_plan(spark, folder))
    return p.select("profile_id", "day", "slot", "dishes", "minutes", *(settled(F.col(n), 3).alias(n) for n in N.NUTRIENTS))


def plate_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each plate's number of different ingredients, the classes of any of its dishes, and whether one has an unresolved string."""
    return fixed_plan(spark, folder).groupBy("profile_id", "day", "slot").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ingr")))).alias("n_items"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))), ",").alias("classes"), F.bool_or("has_unmappable").alias("unmappable"),
    )


def slot_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Dinner candidates that pass, with limits on sodium and sugar as served, less what the fixed plan has used often enough."""
    rows = scoring._filtered(spark, folder).where(F.col("failed").isNull() & F.col("is_dinner"))
    share = N.SLOT_SHARE["dinner"]
    rows = rows.withColumn("helpings", N.servings(F.col("calories"), C.daily()["calories"] * share)).where(
        F.coalesce(F.col("helpings") * F.col("sodium_mg") <= F.col("max_sodium") * share, F.lit(True))
        & F.coalesce(F.col("helpings") * F.col("sugar_g") <= F.col("max_sugar") * share, F.lit(True))
    )
    capped = use_counts(spark, folder).where("n >= 1").select("profile_id", "id")
    return rows.join(capped, ["profile_id", "id"], "left_anti").groupBy("profile_id").agg(F.count("*").alias("n"), settled(F.sum("helpings"), 1).alias("helpings"))


def day_totals(spark: SparkSession, folder: str) -> DataFrame:
    d = planner.days(fixed_plan(spark, folder))
    return d.select("profile_id", "day", *(settled(F.col(n), 3).alias(n) for n in N.NUTRIENTS))


def _with_daily(rows: DataFrame) -> DataFrame:
    """Attach the daily targets of each profile; twelve rows."""
    one = rows.sparkSession.range(1).select(F.inline(C.profile_structs()))
    return rows.join(F.broadcast(one.select("profile_id", *(v.alias(f"d_{n}") for n, v in C.daily().items()))), "profile_id")


def week_stat(spark: SparkSession, folder: str) -> DataFrame:
    """Worst day and mean of each nutrient in percent of its daily amount."""
    d = _with_daily(planner.days(fixed_plan(spark, folder)))
    share = {n: F.col(n) / F.col(f"d_{n}") * 100.0 for n in N.NUTRIENTS}
    return d.groupBy("profile_id").agg(*(settled(F.max(v), 2).alias(f"max_{n}") for n, v in share.items()), *(settled(F.avg(v), 2).alias(f"avg_{n}") for n, v in share.items()))


def attainment(spark: SparkSession, folder: str) -> DataFrame:
    """Mean percent of the quantities to reach, worst percent of the ceilings, and days that meet all four."""
    d = _with_daily(planner.days(fixed_plan(spark, folder)))
    met = F.lit(True)
    for n in N.CEILINGS:
        met = met & (F.col(n) <= F.col(f"d_{n}"))
    reach = [settled(F.avg(F.col(n) / F.col(f"d_{n}") * 100.0), 2).alias(f"reach_{n}") for n in ("calories", *N.TARGETED)]
    worst = [settled(F.max(F.col(n) / F.col(f"d_{n}") * 100.0), 2).alias(f"worst_{n}") for n in N.CEILINGS]
    return d.groupBy("profile_id").agg(*reach, *worst, F.count_if(met).alias("days_met"))


def use_counts(spark: SparkSession, folder: str) -> DataFrame:
    return fixed_plan(spark, folder).groupBy("profile_id", "id").agg(F.count("*").alias("n"))


def day_running(spark: SparkSession, folder: str) -> DataFrame:
    """Energy consumed so far at each slot of a day."""
    p = planner.plates(fixed_plan(spark, folder)).withColumn("ord", F.array_position(F.array(*map(F.lit, planner.SLOTS)), F.col("slot")))
    w = Window.partitionBy("profile_id", "day").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("profile_id", "day", "slot", settled(F.sum("calories").over(w), 3).alias("so_far"))


def leftover_singletons(spark: SparkSession, folder: str) -> DataFrame:
    """Ingredients that a profile's plan uses once, without pantry items."""
    used = fixed_plan(spark, folder).select("profile_id", F.explode("ingr").alias("item")).where("item is not null")
    pantry = F.lit(False)
    for word in PANTRY:
        pantry = pantry | F.col("item").contains(word)
    return used.where(~pantry).groupBy("profile_id", "item").agg(F.count("*").alias("n")).where("n = 1").select("profile_id", "item")


def leftover_suggest(spark: SparkSession, folder: str) -> DataFrame:
    """For each once-used ingredient with enough users, the main that clears most of them, nearest to 30 minutes."""
    once = leftover_singletons(spark, folder)
    mains = table(spark, folder, "corpus", "id", "minutes", "is_side", "ingredients_norm").where(~F.col("is_side"))
    has = mains.select("id", "minutes", F.explode(F.array_distinct("ingredients_norm")).alias("item"))
    pairs = once.join(has, "item")
    clears = pairs.groupBy("profile_id", "id").agg(F.count("*").alias("clears"))
    users = pairs.groupBy("profile_id", "item").agg(F.count("*").alias("users")).where("users >= 3")
    rows = pairs.join(users, ["profile_id", "item"]).join(clears, ["profile_id", "id"])
    best = rows.groupBy("profile_id", "item").agg(F.max_by(F.struct("id", "clears", "minutes"), F.struct("clears", -F.abs(F.col("minutes") - 30), -F.col("id"))).alias("b"))
    ranked = best.select("profile_id", "item", "b.*")
    return content.top_k(ranked, "profile_id", [F.desc("clears"), F.col("item")], 6).select("profile_id", "item", "id", "clears")


def edit_context(spark: SparkSession, folder: str) -> DataFrame:
    """What one slot of a day may take when it is edited: used without it, reserved for empty slots, and the rest."""
    plan = fixed_plan(spark, folder).where("day = 2")
    kcal = plan.groupBy("profile_id").agg(F.sum(F.when(F.col("slot") != "lunch", F.col("servings") * F.col("calories"))).alias("used"), F.count_distinct(F.when(F.col("slot") != "lunch", F.col("slot"))).alias("filled"))
    rows = _with_daily(kcal)
    reserved = F.when(F.col("filled") >= 2, F.lit(0.0)).otherwise(F.col("d_calories") * 0.4)
    return rows.select("profile_id", settled(F.col("used"), 3).alias("used"), settled(reserved, 3).alias("reserved"), settled(F.greatest(F.col("d_calories") - F.col("used"), F.lit(0.0)), 3).alias("allowance"))


def alternatives(spark: SparkSession, folder: str) -> DataFrame:
    """Up to six affordable alternatives by rank among the stored candidates."""
    rows = content.top_k(scoring.admitted(spark, folder), "profile_id", [F.desc("score"), F.col("id")], 200)
    day = C.daily()["calories"]
    fits = N.affordable(F.col("helpings"), F.col("calories"), F.col("slot_kcal"), day * 0.45, F.lit(0.0), day)
    return content.top_k(rows.where((F.col("rn") > 1) & fits), "profile_id", [F.col("rn")], 6, "place").select("profile_id", "place", "id", F.floor(F.col("helpings") * F.col("calories") + 0.5).alias("kcal"))


def replace_next(spark: SparkSession, folder: str) -> DataFrame:
    """The next viable candidate after the current one (the third), and what blocked those passed over."""
    rows = content.top_k(scoring.admitted(spark, folder), "profile_id", [F.desc("score"), F.col("id")], 200).where("rn > 3")
    day = C.daily()["calories"]
    fits = N.affordable(F.col("helpings"), F.col("calories"), F.col("slot_kcal"), day * 0.7, F.lit(0.0), day)
    rows = rows.withColumns({"rejected": F.col("id") % 3 == 0, "fits": fits})
    nxt = rows.groupBy("profile_id").agg(F.min(F.when(~F.col("rejected") & F.col("fits"), F.col("rn"))).alias("next_rn"))
    both = rows.join(nxt, "profile_id")
    before = F.col("next_rn").isNull() | (F.col("rn") < F.col("next_rn"))
    return both.groupBy("profile_id").agg(
        F.max(F.when(F.col("rn") == F.col("next_rn"), F.col("id"))).alias("id"), F.count_if(before & F.col("rejected")).alias("blocked_by_filter"),
        F.count_if(before & ~F.col("rejected") & ~F.col("fits")).alias("blocked_by_budget"),
    )


def choose_alternative(spark: SparkSession, folder: str) -> DataFrame:
    """A dinner after lunch, whose main is then rejected and replaced with new sides, lunch as it is."""
    p = planner.Planner(cut(pool(spark, folder)), C.PROFILES)
    p.fill(0, "lunch")
    p.fill(0, "dinner")
    p.replace(0, "dinner")
    return planner.as_table(spark, p.plan()).drop("ingr")


def plan_sides(spark: SparkSession, folder: str) -> DataFrame:
    """The side that best closes a gap of 30 % of dinner, for each profile."""
    sides = C.items(spark, folder, "is_side").where("is_side")
    rows = C.for_profiles(sides)
    gap = C.daily()["calories"] * 0.4 * 0.3
    helpings = N.servings(F.col("calories"), gap)
    kcal = helpings * F.col("calories")
    rows = rows.withColumns({"gap": gap, "helpings": helpings, "kcal": kcal, "score": settled(C.taste() * 0.4 - N.energy_penalty(F.col("calories"), helpings, gap) * 0.4, 6)})
    rows = rows.where((F.col("gap") >= N.LEAST_GAP) & (F.col("kcal") >= N.LEAST_SIDE) & (F.abs(F.col("gap") - F.col("kcal")) < F.col("gap")))
    best = rows.groupBy("profile_id").agg(F.max_by(F.struct("id", "score", "helpings"), F.struct("score", -F.col("id"))).alias("b"))
    return best.select("profile_id", "b.*")


def plan_day_mains(spark: SparkSession, folder: str) -> DataFrame:
    """Mains of one day, each slot after the energy that the earlier ones took."""
    rows = C.items(spark, folder, "is_side", "is_breakfast", "is_lunch", "is_dinner").where(~F.col("is_side"))
    one = spark.range(1).select(F.inline(C.profile_structs()))
    state = one.select("profile_id", C.daily()["calories"].alias("kcal"), F.lit(0.0).alias("eaten"), F.array().cast("array<long>").alias("ids"))
    picks = []
    for i, slot in enumerate(planner.SLOTS):
        share = N.open_share(slot, planner.SLOTS[i:])
        found = C.for_profiles(rows.where(F.col(f"is_{slot}"))).join(F.broadcast(state), "profile_id")  # twelve rows
        target = F.greatest(F.col("kcal") - F.col("eaten"), F.lit(0.0)) * share * N.MAIN_SHARE
        helpings = N.servings(F.col("calories"), target)
        score = settled(C.taste() - N.energy_penalty(F.col("calories"), helpings, target) * 0.4, 6)
        found = found.where(~F.array_contains("ids", F.col("id"))).withColumns({"helpings": helpings, "score": score})
        best = found.groupBy("profile_id").agg(F.max_by(F.struct("id", "helpings", "calories", "score"), F.struct("score", -F.col("id"))).alias("b"))
        picks.append(best.select("profile_id", F.lit(slot).alias("slot"), "b.id", "b.helpings", "b.score"))
        state = cut(state.join(best, "profile_id", "left").select(
            "profile_id", "kcal", (F.col("eaten") + F.coalesce(F.col("b.helpings") * F.col("b.calories"), F.lit(0.0))).alias("eaten"),
            F.array_compact(F.concat("ids", F.array("b.id"))).alias("ids"),
        ))
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


def ild(spark: SparkSession, folder: str) -> DataFrame:
    mains = fixed_plan(spark, folder).where("role = 'main'").withColumn("at", F.concat_ws("-", "day", "slot"))
    return ranking.dissimilarity(mains, "profile_id", "ingr", "at").select("profile_id", settled(F.col("ild")).alias("ild"))


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    c = ranking.coverage(fixed_plan(spark, folder), "id", table(spark, folder, "corpus", "id").count())
    return c.select("distinct_items", settled(F.col("coverage"), 6).alias("coverage"), settled(F.col("top_share"), 6).alias("top_share"), "used_once")


def popularity_week(spark: SparkSession, folder: str) -> DataFrame:
    """The seven most rated mains of each slot."""
    counts = C.ratings(spark, folder).groupBy("id").agg(F.count("*").alias("n"))
    mains = table(spark, folder, "corpus", "id", "is_side", "is_breakfast", "is_lunch", "is_dinner").where(~F.col("is_side"))
    rows = mains.select("id", F.explode(F.array_compact(F.array(*(F.when(F.col(f"is_{s}"), F.lit(s)) for s in planner.SLOTS)))).alias("slot")).join(counts, "id")
    return content.top_k(rows, "slot", [F.desc("n"), F.col("id")], 7).select("slot", "rn", "id", "n")


def ablation(spark: SparkSession, folder: str) -> DataFrame:
    """Popular weeks with and without the hard filter: meals that hold an avoided class or go over time."""
    counts = C.ratings(spark, folder).groupBy("id").agg(F.count("*").alias("n"))
    mains = scoring._filtered(spark, folder).join(table(spark, folder, "corpus", "id", "is_breakfast", "is_lunch"), "id")
    slots = F.explode(F.array_compact(F.array(*(F.when(F.col(f"is_{s}"), F.lit(s)) for s in planner.SLOTS))))
    rows = mains.select("profile_id", "id", "minutes", "failed", slots.alias("slot")).join(counts, "id")
    arms = {"popularity": rows, "popularity and filter": rows.where("failed is null")}
    out = []
    for name, arm in arms.items():
        week = content.top_k(arm, ["profile_id", "slot"], [F.desc("n"), F.col("id")], 7)
        out.append(week.agg(F.lit(name).alias("arm"), F.count("*").alias("meals"), F.count_if(F.col("failed") == "avoided class").alias("violations"), F.count_if(F.col("minutes") > 30).alias("over_time")))
    return out[0].unionByName(out[1])


QUERIES = {
    f.__name__: f
    for f in (
        plan_week, plan_relax, plan_locked, plan_evaluation, plate_totals, plate_items, slot_filter, day_totals, week_stat, attainment, use_counts, day_running, leftover_singletons, leftover_suggest,
        edit_context, alternatives, replace_next, choose_alternative, plan_sides, plan_day_mains, ild, coverage, popularity_week, ablation,
    )
}

S = C.settled_sql
_KEY = "(id * 7919 + profile_id * 104729) % 100003"
_CLASSED = "classed AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {_fires(c)} THEN '{c}' END" for c in SAMPLE.classes) + "], lambda x: x IS NOT NULL) AS classes FROM (SELECT *, lower(array_to_string(ingredients, ' | ')) AS text FROM items))"
_PLAN = _CLASSED + ", slotted AS (" + " UNION ALL ".join(
    [f"SELECT *, '{s}' AS s FROM classed WHERE is_{s} AND NOT is_side" for s in planner.SLOTS] + ["SELECT *, 'side' AS s FROM classed WHERE is_side"]
) + f"""), ranked AS (SELECT i.*, d.*, row_number() OVER (PARTITION BY profile_id, s ORDER BY {_KEY}, id) AS rn FROM slotted i, daily d),
plan AS (SELECT *, CASE WHEN s = 'side' THEN (rn - 1) // 3 ELSE rn - 1 END::INTEGER AS day, CASE WHEN s = 'side' THEN ['breakfast', 'lunch', 'dinner'][(rn - 1) % 3 + 1] ELSE s END AS slot,
    CASE WHEN s = 'side' THEN 'side' ELSE 'main' END AS role, 0.5e0 + 0.5e0 * ((id + profile_id) % 3) AS servings, coalesce(ingredients_norm, []) AS ingr, classes FROM ranked WHERE rn <= 7 OR (s = 'side' AND rn <= 21)),
days AS (SELECT profile_id, day, {", ".join(f"sum(servings * {n}) AS {n}, any_value(d_{n}) AS d_{n}" for n in N.NUTRIENTS)} FROM plan GROUP BY 1, 2),
plates AS (SELECT profile_id, day, slot, count(*) AS dishes, sum(minutes)::BIGINT AS minutes, {", ".join(f"sum(servings * {n}) AS {n}" for n in N.NUTRIENTS)} FROM plan GROUP BY 1, 2, 3),
once AS (SELECT profile_id, item FROM (SELECT profile_id, unnest(ingr) AS item FROM plan) WHERE item IS NOT NULL AND NOT ({" OR ".join(f"contains(item, '{w}')" for w in PANTRY)}) GROUP BY 1, 2 HAVING count(*) = 1)
"""
_FIXED = "WITH " + C.PROFILES_SQL + ", " + C.ITEMS_SQL + ", " + _PLAN
_RANKED = SCORED_SQL + ", " + _admitted_sql() + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, id) AS rn FROM admitted)"
_COUNTS = ", " + C.RATINGS_SQL + ", pop AS (SELECT id, count(*) AS n FROM ratings GROUP BY 1)"


def _fits(used: float) -> str:
    return f"d_calories * {used}e0 + greatest(helpings * calories, slot_kcal) + 0e0 <= d_calories * 1.1e0"


def _day_sql() -> str:
    parts = ["WITH " + C.PROFILES_SQL, C.ITEMS_SQL, "st0 AS (SELECT profile_id, d_calories AS kcal, 0e0 AS eaten, []::BIGINT[] AS ids FROM daily)"]
    for i, slot in enumerate(planner.SLOTS):
        share = N.open_share(slot, planner.SLOTS[i:])
        parts.append(f"c{i} AS (SELECT st{i}.*, id, calories, ((id * 7919 + profile_id * 104729) % 1000)::DOUBLE / 1000e0 AS taste, greatest(kcal - eaten, 0e0) * {share!r}::DOUBLE * 0.55e0 AS t FROM items, st{i} WHERE is_{slot} AND NOT is_side AND NOT list_contains(ids, id))")
        parts.append(f"h{i} AS (SELECT *, {_servings_sql('t')} AS helpings FROM c{i})")
        parts.append(f"p{i} AS (SELECT *, {S('taste - abs(helpings * calories - greatest(t, 1e0)) / greatest(t, 1e0) * 0.4e0', 6)} AS score FROM h{i} QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY {S('taste - abs(helpings * calories - greatest(t, 1e0)) / greatest(t, 1e0) * 0.4e0', 6)} DESC, id) = 1)")
        parts.append(f"st{i + 1} AS (SELECT s.profile_id, s.kcal, s.eaten + coalesce(p.helpings * p.calories, 0e0) AS eaten, CASE WHEN p.id IS NULL THEN s.ids ELSE list_append(s.ids, p.id) END AS ids FROM st{i} s LEFT JOIN p{i} p USING (profile_id))")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT profile_id, '{s}' AS slot, id, helpings, score FROM p{i}" for i, s in enumerate(planner.SLOTS))


SQL = {
    "plate_totals": _FIXED + "SELECT profile_id, day, slot, dishes, minutes, " + ", ".join(f"{S(n, 3)} AS {n}" for n in N.NUTRIENTS) + " FROM plates",
    "plate_items": _FIXED + """, e AS (SELECT profile_id, day, slot, unnest(CASE WHEN len(ingr) = 0 THEN [NULL] ELSE list_transform(ingr, lambda x: coalesce(x, chr(1))) END) AS i FROM plan),
        n AS (SELECT profile_id, day, slot, count(DISTINCT i)::INTEGER AS n_items FROM e GROUP BY 1, 2, 3), c AS (SELECT DISTINCT profile_id, day, slot, unnest(classes) AS c FROM plan),
        u AS (SELECT profile_id, day, slot, string_agg(c, ',' ORDER BY c) AS classes FROM c GROUP BY 1, 2, 3), b AS (SELECT profile_id, day, slot, bool_or(has_unmappable) AS unmappable FROM plan GROUP BY 1, 2, 3)
        SELECT profile_id, day, slot, n_items, coalesce(classes, '') AS classes, unmappable FROM n JOIN b USING (profile_id, day, slot) LEFT JOIN u USING (profile_id, day, slot)""",
    "slot_filter": scoring._FILTER + ", " + _PLAN + f", s AS (SELECT *, {_servings_sql('(d_calories * 0.4e0)')} AS helpings FROM filtered WHERE failed IS NULL AND is_dinner) SELECT profile_id, count(*) AS n, {S('sum(helpings)', 1)} AS helpings FROM s "
    "WHERE coalesce(helpings * sodium_mg <= max_sodium * 0.4e0, true) AND coalesce(helpings * sugar_g <= max_sugar * 0.4e0, true) AND NOT EXISTS (SELECT 1 FROM plan p WHERE p.profile_id = s.profile_id AND p.id = s.id) GROUP BY 1",
    "day_totals": _FIXED + "SELECT profile_id, day, " + ", ".join(f"{S(n, 3)} AS {n}" for n in N.NUTRIENTS) + " FROM days",
    "week_stat": _FIXED + "SELECT profile_id, " + ", ".join(f"{S(f'max({n} / d_{n} * 100e0)', 2)} AS max_{n}, {S(f'avg({n} / d_{n} * 100e0)', 2)} AS avg_{n}" for n in N.NUTRIENTS) + " FROM days GROUP BY 1",
    "attainment": _FIXED + "SELECT profile_id, " + ", ".join(f"{S(f'avg({n} / d_{n} * 100e0)', 2)} AS reach_{n}" for n in ("calories", *N.TARGETED)) + ", " + ", ".join(f"{S(f'max({n} / d_{n} * 100e0)', 2)} AS worst_{n}" for n in N.CEILINGS)
    + ", count(*) FILTER (" + " AND ".join(f"{n} <= d_{n}" for n in N.CEILINGS) + ") AS days_met FROM days GROUP BY 1",
    "use_counts": _FIXED + "SELECT profile_id, id, count(*) AS n FROM plan GROUP BY 1, 2",
    "day_running": _FIXED + f"SELECT profile_id, day, slot, {S('sum(calories) OVER (PARTITION BY profile_id, day ORDER BY list_position([$$breakfast$$, $$lunch$$, $$dinner$$], slot) ROWS UNBOUNDED PRECEDING)', 3)} AS so_far FROM plates",
    "leftover_singletons": _FIXED + "SELECT * FROM once",
    "leftover_suggest": _FIXED + """, has AS (SELECT DISTINCT id, minutes, item FROM (SELECT id, minutes, unnest(ingredients_norm) AS item FROM corpus WHERE NOT is_side)),
        pairs AS (SELECT profile_id, item, id, minutes, count(*) OVER (PARTITION BY profile_id, id) AS clears, count(*) OVER (PARTITION BY profile_id, item) AS users FROM once JOIN has USING (item)),
        best AS (SELECT * FROM pairs WHERE users >= 3 QUALIFY row_number() OVER (PARTITION BY profile_id, item ORDER BY clears DESC, abs(minutes - 30), id) = 1)
        SELECT profile_id, item, id, clears FROM best QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY clears DESC, item) <= 6""",
    "edit_context": _FIXED + f""", k AS (SELECT profile_id, sum(servings * calories) FILTER (slot <> 'lunch') AS used, count(DISTINCT slot) FILTER (slot <> 'lunch') AS filled, any_value(d_calories) AS d FROM plan WHERE day = 2 GROUP BY 1)
        SELECT profile_id, {S('used', 3)} AS used, {S('CASE WHEN filled >= 2 THEN 0e0 ELSE d * 0.4e0 END', 3)} AS reserved, {S('greatest(d - used, 0e0)', 3)} AS allowance FROM k""",
    "alternatives": _RANKED + f", f AS (SELECT * FROM ranked WHERE rn > 1 AND rn <= 200 AND {_fits(0.45)}) SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY rn)::INTEGER AS place, id, floor(helpings * calories + 0.5e0)::BIGINT AS kcal FROM f QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY rn) <= 6",
    "replace_next": _RANKED + f""", r AS (SELECT *, id % 3 = 0 AS rejected, {_fits(0.7)} AS fits FROM ranked WHERE rn > 3 AND rn <= 200),
        x AS (SELECT profile_id, min(rn) FILTER (NOT rejected AND fits) AS next_rn FROM r GROUP BY 1)
        SELECT profile_id, max(id) FILTER (rn = next_rn) AS id, count(*) FILTER ((next_rn IS NULL OR rn < next_rn) AND rejected) AS blocked_by_filter,
        count(*) FILTER ((next_rn IS NULL OR rn < next_rn) AND NOT rejected AND NOT fits) AS blocked_by_budget FROM r JOIN x USING (profile_id) GROUP BY 1""",
    "plan_sides": "WITH " + C.PROFILES_SQL + ", " + C.ITEMS_SQL + f""", c AS (SELECT *, d_calories * 0.4e0 * 0.3e0 AS gap FROM items, daily WHERE is_side),
        h AS (SELECT *, {_servings_sql("gap")} AS helpings FROM c),
        s AS (SELECT *, helpings * calories AS kcal, {S("((id * 7919 + profile_id * 104729) % 1000)::DOUBLE / 1000e0 * 0.4e0 - abs(helpings * calories - greatest(gap, 1e0)) / greatest(gap, 1e0) * 0.4e0", 6)} AS score FROM h)
        SELECT profile_id, id, score, helpings FROM s WHERE gap >= 80 AND kcal >= 40 AND abs(gap - kcal) < gap QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, id) = 1""",
    "plan_day_mains": _day_sql(),
    "ild": _FIXED + f""", m AS (SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY day, slot) AS r, list_distinct(ingr) AS s FROM plan WHERE role = 'main'),
        p AS (SELECT a.profile_id, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS u FROM m a JOIN m b ON a.profile_id = b.profile_id AND a.r < b.r)
        SELECT profile_id, {S("avg(CASE WHEN u = 0 THEN 0e0 ELSE 1e0 - i / u::DOUBLE END)")} AS ild FROM p GROUP BY 1""",
    "coverage": _FIXED + f", u AS (SELECT id, count(*) AS n FROM plan GROUP BY 1) SELECT count(*) AS distinct_items, {S('count(*)::DOUBLE / (SELECT count(*) FROM corpus)', 6)} AS coverage, {S('max(n)::DOUBLE / sum(n)', 6)} AS top_share, count(*) FILTER (n = 1) AS used_once FROM u",
    "popularity_week": "WITH x AS (SELECT 1)" + _COUNTS + ", r AS (" + " UNION ALL ".join(f"SELECT '{s}' AS slot, id, n FROM corpus JOIN pop USING (id) WHERE is_{s} AND NOT is_side" for s in planner.SLOTS) + ") SELECT slot, row_number() OVER (PARTITION BY slot ORDER BY n DESC, id)::INTEGER AS rn, id, n FROM r QUALIFY row_number() OVER (PARTITION BY slot ORDER BY n DESC, id) <= 7",
    "ablation": scoring._FILTER + _COUNTS + ", r AS (" + " UNION ALL ".join(f"SELECT profile_id, '{s}' AS slot, id, minutes, failed, n FROM filtered JOIN pop USING (id) WHERE is_{s}" for s in planner.SLOTS) + ") " + " UNION ALL ".join(
        f"SELECT '{a}' AS arm, count(*) AS meals, count(*) FILTER (failed = 'avoided class') AS violations, count(*) FILTER (minutes > 30) AS over_time FROM (SELECT * FROM r WHERE {w} QUALIFY row_number() OVER (PARTITION BY profile_id, slot ORDER BY n DESC, id) <= 7)"
        for a, w in (("popularity", "true"), ("popularity and filter", "failed IS NULL"))
    ),
}

"""Targets, penalties, gates, filters and top-k queries over items and a block of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import nutrition as N
from platewise.functions import text as T
from platewise.functions.numeric import settled
from platewise.operators import content
from platewise.operators.cleaning import first_rule
from platewise.operators.lexicon import joined_text
from platewise.plans import common as C
from platewise.plans.profiling import TAGS_SQL
from platewise.plans.text import BLACKLIST, SAMPLE, _fires, tag_and_term_flags
from platewise.runtime import cut
from platewise.sources.tables import table

USED = ("salt", "onion", "butter", "water", "sugar")
SLOT = "dinner"


def vocabulary_items(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, ingr)``: each row's distinct ingredients that at least two rows have."""
    pairs = ingredient_matrix(spark, folder)
    return pairs.groupBy("id").agg(F.collect_set("ingr").alias("ingr"))


def ingredient_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (row, ingredient) pairs of ingredients in at least two rows."""
    pairs = table(spark, folder, "corpus", "id", "ingredients_norm").select("id", F.explode("ingredients_norm").alias("ingr")).where("ingr is not null").distinct()
    df = pairs.groupBy("ingr").agg(F.count("*").alias("df")).where("df >= 2")
    return pairs.join(df, "ingr").select("id", "ingr")


def scored(spark: SparkSession, folder: str, slot: str = SLOT, emphasis: float = N.CEILING_EMPHASIS, often: bool = False) -> DataFrame:
    """Mains of a slot for each profile with helpings, the four penalties and a relevance.

    With ``often`` the items and their ingredients are written before the profiles
    meet them, so a plan that reads the scores more than once joins once.
    """
    rows = C.items(spark, folder, f"is_{slot}", "is_side").where(F.col(f"is_{slot}") & ~F.col("is_side"))
    rows = rows.join(vocabulary_items(spark, folder), "id", "left")
    rows = cut(rows) if often else rows
    rows = C.for_profiles(rows.withColumn("ingr", F.coalesce("ingr", F.array().cast("array<string>"))))
    daily = C.daily()
    target = N.allowance(daily, {n: F.lit(0.0) for n in daily}, N.SLOT_SHARE[slot], N.MAIN_SHARE)
    rows = rows.withColumns({f"t_{n}": c for n, c in target.items()}).withColumn("slot_kcal", daily["calories"] * N.SLOT_SHARE[slot])
    rows = rows.withColumn("helpings", N.servings(F.col("calories"), F.col("t_calories")))
    t = {n: F.col(f"t_{n}") for n in N.NUTRIENTS}
    return rows.withColumns({
        "energy": N.energy_penalty(F.col("calories"), F.col("helpings"), t["calories"]),
        "macros": N.nutrition_penalty({n: F.col(n) for n in N.NUTRIENTS}, F.col("helpings"), t, emphasis),
        "repetition": N.repetition_penalty(F.col("ingr"), F.array(*map(F.lit, USED))),
        "time": N.time_penalty(F.col("minutes"), F.col("weekday_minutes")),
        "taste": C.taste(),
    })


def _penalties() -> dict[str, Column]:
    return {n: F.col(n) for n in ("energy", "macros", "repetition", "time")}


def _scaled(rows: DataFrame, by: list[str]) -> DataFrame:
    """Relevance scaled between the least and the greatest taste of each group; a row per group is broadcast."""
    ends = rows.groupBy(*by).agg(F.min("taste").alias("low"), F.max("taste").alias("high"))
    return rows.join(F.broadcast(ends), by).withColumn("relevance", N.scaled_relevance(F.col("taste"), F.col("low"), F.col("high")))


def admitted(spark: SparkSession, folder: str, level: int = 0, emphasis: float = N.CEILING_EMPHASIS) -> DataFrame:
    """Rows inside the gates with their relevance scaled within the admitted set, and the score."""
    rows = _scaled(scored(spark, folder, emphasis=emphasis, often=True).where(N.admissible(_penalties(), level)), ["profile_id"])
    return rows.withColumn("score", settled(N.combine(F.col("relevance"), _penalties(), N.relaxed_weights(level)), 6))


def bmr_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Daily targets of every customer, attributes by rule from the key."""
    c = table(spark, folder, "customer", "c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    activity = F.when(F.col("c_mktsegment") == "BUILDING", 1.4).when(F.col("c_mktsegment") == "MACHINERY", 1.6).when(F.col("c_mktsegment") == "HOUSEHOLD", 1.75).otherwise(1.9)
    weight, height, age = (50 + k % 45).cast("double"), (150 + k % 40).cast("double"), (20 + k % 45).cast("double")
    targets = N.daily_targets(N.basal_rate(weight, height, age, k % 2 == 1), activity, weight)
    return c.select("c_custkey", *(settled(v).alias(n) for n, v in targets.items()))


def slot_shares_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Energy of each slot of a day, per profile."""
    one = spark.range(1).select(F.inline(C.profile_structs()))
    shares = F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(v).alias("share")) for s, v in N.SLOT_SHARE.items()))
    return one.select("profile_id", C.daily()["calories"].alias("kcal"), F.inline(shares)).select("profile_id", "slot", settled(F.col("kcal") * F.col("share")).alias("kcal"))


def slot_allowance(spark: SparkSession, folder: str) -> DataFrame:
    """What dinner may take after a breakfast and a lunch that used fixed parts of the day."""
    daily = C.daily()
    eaten = {n: daily[n] * f for n, f in zip(daily, (0.5, 0.7, 0.4, 1.2, 0.9, 0.3, 0.6), strict=True)}
    left = N.allowance(daily, eaten, N.open_share("dinner", ("dinner",)))
    return spark.range(1).select(F.inline(C.profile_structs())).select("profile_id", *(settled(v).alias(n) for n, v in left.items()))


def servings(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).groupBy("profile_id", "helpings").agg(F.count("*").alias("n"))


def penalties(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("profile_id", "id", *(settled(c).alias(n) for n, c in _penalties().items()))


def soft_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Admitted rows per profile at each level of relaxation."""
    levels = {f"level_{i}": F.count_if(N.admissible(_penalties(), i)) for i in range(5)}
    return scored(spark, folder).groupBy("profile_id").agg(*(c.alias(n) for n, c in levels.items()))


def relevance_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return admitted(spark, folder).select("profile_id", "id", settled(F.col("relevance")).alias("relevance"))


def combine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best rows of each profile."""
    return content.top_k(admitted(spark, folder), "profile_id", [F.desc("score"), F.col("id")], 10).select("profile_id", "rn", "id", "score", "helpings")


def contributions(spark: SparkSession, folder: str) -> DataFrame:
    """Signed terms of the best row of each profile."""
    best = content.top_k(admitted(spark, folder), "profile_id", [F.desc("score"), F.col("id")], 1)
    return best.select("profile_id", "id", *(settled(c).alias(f"term_{n}") for n, c in N.contributions(F.col("relevance"), _penalties()).items()))


def relax_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The best row of each profile at each level, gates and weights given up in order: all levels in one pass."""
    levels = F.array_compact(F.array(*(F.when(N.admissible(_penalties(), i), F.lit(i)) for i in range(5))))
    rows = _scaled(scored(spark, folder, often=True).withColumn("level", F.explode(levels)), ["profile_id", "level"])
    given = [settled(N.combine(F.col("relevance"), _penalties(), N.relaxed_weights(i)), 6) for i in range(5)]
    rows = rows.withColumn("score", F.element_at(F.array(*given), F.col("level") + 1))
    best = rows.groupBy("level", "profile_id").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b"))
    return best.select("level", "profile_id", "b.id", "b.score")


def relax_note(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(5).select(F.col("id").cast("int").alias("level")).select("level", N.relaxation_note(F.col("level")).alias("note"))


def sweep_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    """Mean nutrition penalty of all rows for each weight of the ceilings, in one pass."""
    rows = scored(spark, folder)
    t = {n: F.col(f"t_{n}") for n in N.NUTRIENTS}
    item = {n: F.col(n) for n in N.NUTRIENTS}
    return rows.select(
        "profile_id", F.explode(F.array(*(F.struct(F.lit(w).alias("weight"), N.nutrition_penalty(item, F.col("helpings"), t, w).alias("m")) for w in (0.0, 1.0, 2.0, 4.0)))).alias("x")
    ).groupBy("profile_id", F.col("x.weight").alias("weight")).agg(settled(F.avg("x.m"), 3).alias("mean_penalty"))


def sweep_main_share(spark: SparkSession, folder: str) -> DataFrame:
    """Energy penalty of the best main for each share of the slot that mains may take, in one pass."""
    rows = C.items(spark, folder, f"is_{SLOT}", "is_side").where(F.col(f"is_{SLOT}") & ~F.col("is_side"))
    rows = C.for_profiles(rows).withColumn("share", F.explode(F.array(*map(F.lit, (0.55, 0.65, 0.75)))))
    target = C.daily()["calories"] * N.SLOT_SHARE[SLOT] * F.col("share")
    rows = rows.withColumn("energy", N.energy_penalty(F.col("calories"), N.servings(F.col("calories"), target), target))
    return rows.groupBy("profile_id", "share").agg(settled(F.min("energy"), 6).alias("least"), settled(F.avg("energy"), 3).alias("mean"))


def flagged(items: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Items with their lower-case text, the classes and the regimes that profiles name; ``ingredients`` is dropped."""
    text = joined_text("ingredients")
    rows = items.withColumns({"text": text, "has_egg": SAMPLE.fires(text, "egg"), "has_nut": SAMPLE.fires(text, "nut")}).drop("ingredients")
    return rows.join(tag_and_term_flags(spark, folder), "id", "left")


def profile_rules(profiles: list[dict] = C.PROFILES) -> list[tuple[str, Column]]:
    """What excludes an item for a profile, in order: avoided classes, unresolved strings, the regime, banned terms."""
    avoids = ((F.col("avoid") == "egg") & F.col("has_egg")) | ((F.col("avoid") == "nut") & F.col("has_nut"))
    fits = {"vegetarian": F.col("vegetarian"), "vegan": F.col("vegan"), "third": F.col("no_listed_term")}
    outside, banned = F.lit(False), F.lit(False)
    for regime, ok in fits.items():
        outside = outside | ((F.col("regime") == regime) & ~F.coalesce(ok, F.lit(False)))
    for term in sorted({p["banned"] for p in profiles if p["banned"]}):
        banned = banned | ((F.col("banned") == term) & T.excluded(F.col("text"), term))
    return [("avoided class", avoids), ("unresolved item", (F.col("avoid") != "") & F.col("has_unmappable")), ("outside regime", outside), ("banned term", banned)]


def _filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Mains and profiles with the ordered rules of the hard filter and the first that excludes."""
    rows = C.items(spark, folder, "is_side", "has_unmappable", "ingredients", "is_dinner").where(~F.col("is_side"))
    return C.for_profiles(flagged(rows, spark, folder)).withColumn("failed", first_rule(profile_rules()))


def hard_filter_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that each rule removes after the earlier ones; null for those that stay."""
    return _filtered(spark, folder).groupBy("profile_id", "failed").agg(F.count("*").alias("n"))


def affordable(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder)
    day = C.daily()["calories"]
    fits = N.affordable(F.col("helpings"), F.col("calories"), F.col("slot_kcal"), day * 0.45, day * 0.2, day)
    return rows.groupBy("profile_id").agg(F.count("*").alias("n"), F.count_if(fits).alias("n_affordable"))


def drift(spark: SparkSession, folder: str) -> DataFrame:
    """Fields in which two versions of a profile differ, nulls comparing equal, and whether a safety field does."""
    one = spark.range(1).select(F.inline(C.profile_structs()))
    later = one.withColumns({"weight_kg": F.col("weight_kg") + F.when(F.col("profile_id") % 4 == 0, 1.0).otherwise(0.0), "avoid": F.when(F.col("profile_id") % 6 == 1, F.lit("nut")).otherwise(F.col("avoid"))})
    fields = ("age", "weight_kg", "activity", "max_sodium", "avoid", "banned")
    both = one.alias("a").join(later.alias("b"), "profile_id")
    changed = {f: ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields}
    names = F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in changed.items())))
    return both.select("profile_id", F.array_join(names, ",").alias("changed"), (changed["avoid"] | changed["max_sodium"] | changed["banned"]).alias("safety"))


def plan_slot(spark: SparkSession, folder: str) -> DataFrame:
    """One filled slot: top 50 by score, look-ahead for what later slots need, then the best."""
    rows = content.top_k(admitted(spark, folder), "profile_id", [F.desc("score"), F.col("id")], 50)
    day = C.daily()["calories"]
    ahead = N.look_ahead(F.col("helpings"), F.col("calories"), F.col("slot_kcal"), day * 0.2, day, day * 0.45)
    rows = rows.withColumns({"ahead": settled(ahead, 6), "final": settled(F.col("score") + settled(ahead, 6), 6)})
    best = rows.groupBy("profile_id").agg(F.max_by(F.struct("id", "score", "ahead", "final", "helpings"), F.struct("final", -F.col("id"))).alias("b"))
    return best.select("profile_id", "b.*")


QUERIES = {
    f.__name__: f
    for f in (
        ingredient_matrix, bmr_targets, slot_shares_fixed, slot_allowance, servings, penalties, soft_gates, relevance_scaled, combine_topk, contributions,
        relax_levels, relax_note, sweep_ceiling, sweep_main_share, hard_filter_report, affordable, drift, plan_slot,
    )
}

S = C.settled_sql
_VOCAB = """
pairs AS (SELECT DISTINCT id, ingr FROM (SELECT id, unnest(ingredients_norm) AS ingr FROM corpus) WHERE ingr IS NOT NULL),
matrix AS (SELECT id, ingr FROM pairs WHERE ingr IN (SELECT ingr FROM pairs GROUP BY ingr HAVING count(*) >= 2)),
vocab AS (SELECT id, list(ingr) AS ingr FROM matrix GROUP BY id)
"""


def _penalty_sql(weight: str) -> str:
    off = " + ".join(f"abs(helpings * {n} - t_{n}) / greatest(t_{n}, 1e-6)" for n in N.TARGETED)
    over = " + ".join(f"greatest(helpings * {n} - t_{n}, 0e0) / greatest(t_{n}, 1e-6)" for n in N.CEILINGS)
    return f"(({off}) / 2e0 + (({over}) / 4e0) * {weight})"


_RAW = "CASE WHEN calories <= 0 THEN 1e0 ELSE {t} / calories END"


def _servings_sql(target: str) -> str:
    return f"least(greatest(round_even(({_RAW.format(t=target)}) / 0.5e0, 0) * 0.5e0, 0.5e0), 1.5e0)"


SCORED_SQL = "WITH " + C.PROFILES_SQL + ", " + C.ITEMS_SQL + ", " + _VOCAB + f""",
cand AS (SELECT i.*, coalesce(v.ingr, []) AS ingr, d.*, {", ".join(f"greatest(d_{n} - 0e0, 0e0) * 0.4e0 * 0.55e0 AS t_{n}" for n in N.NUTRIENTS)}, d_calories * 0.4e0 AS slot_kcal
    FROM items i LEFT JOIN vocab v USING (id), daily d WHERE i.is_{SLOT} AND NOT i.is_side),
served AS (SELECT *, {_servings_sql("t_calories")} AS helpings FROM cand),
scored AS (SELECT *, abs(helpings * calories - greatest(t_calories, 1e0)) / greatest(t_calories, 1e0) AS energy, {_penalty_sql("4e0")} AS macros,
    len(list_intersect(ingr, [{", ".join(f"'{u}'" for u in USED)}]))::DOUBLE / greatest(len(ingr), 1) AS repetition, greatest(minutes::DOUBLE - 30e0, 0e0) / 30e0 AS time,
    ((id * 7919 + profile_id * 104729) % 1000)::DOUBLE / 1000e0 AS taste FROM served)
"""
_GATE = {"time": "time <= 1.0e0", "repetition": "repetition <= 0.6e0", "macros": "macros <= 1.5e0", "energy": "energy <= 0.25e0"}


def _gates(level: int) -> str:
    return " AND ".join(["true", *(_GATE[n] for n in N.RELAXATION_ORDER[level:])])


def _admitted_sql(level: int = 0, name: str = "admitted") -> str:
    w = N.relaxed_weights(level)
    return f"""{name} AS (SELECT *, {S(f"relevance * {w['relevance']}e0 - energy * {w['energy']}e0 - macros * {w['macros']}e0 - repetition * {w['repetition']}e0 - time * {w['time']}e0", 6)} AS score FROM (
    SELECT *, CASE WHEN max(taste) OVER w > min(taste) OVER w THEN (taste - min(taste) OVER w) / (max(taste) OVER w - min(taste) OVER w) ELSE 0.5e0 END AS relevance
    FROM scored WHERE {_gates(level)} WINDOW w AS (PARTITION BY profile_id)))"""


_TOP = "QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, id) <= {k}"
_AHEAD = "greatest(d_calories * 0.45e0 - (d_calories * 1.1e0 - d_calories * 0.2e0 - greatest(helpings * calories, slot_kcal)), 0e0) / greatest(d_calories * 0.45e0, 1e0) * -0.4e0"
_TEXT = "lower(array_to_string(ingredients, ' | '))"
_FILTER = "WITH " + TAGS_SQL + ", " + C.PROFILES_SQL + ", " + C.ITEMS_SQL + f""", mains AS (SELECT *, {_TEXT} AS text FROM items WHERE NOT is_side),
tagged AS (SELECT *, {_fires("egg")} AS has_egg, {_fires("nut")} AS has_nut, id IN (SELECT id FROM tag_set WHERE tag = 'vegetarian') AS vegetarian,
    id IN (SELECT id FROM tag_set WHERE tag = 'vegan') AS vegan, NOT coalesce({" OR ".join(f"contains(text, '{t}')" for t in BLACKLIST)}, false) AS no_listed_term FROM mains),
filtered AS (SELECT t.*, d.*, CASE WHEN (avoid = 'egg' AND has_egg) OR (avoid = 'nut' AND has_nut) THEN 'avoided class' WHEN avoid <> '' AND has_unmappable THEN 'unresolved item'
    WHEN (regime = 'vegetarian' AND NOT vegetarian) OR (regime = 'vegan' AND NOT vegan) OR (regime = 'third' AND NOT no_listed_term) THEN 'outside regime'
    WHEN {" OR ".join(f"coalesce(banned = '{t}' AND regexp_matches(text, '{T.exclusion_pattern(t)}'), false)" for t in ("oats", "olives"))} THEN 'banned term' END AS failed FROM tagged t, daily d)
"""
SQL = {
    "ingredient_matrix": "WITH " + _VOCAB + "SELECT id, ingr FROM matrix",
    "bmr_targets": "WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1.4e0 WHEN 'MACHINERY' THEN 1.6e0 WHEN 'HOUSEHOLD' THEN 1.75e0 ELSE 1.9e0 END AS a, (50 + c_custkey % 45)::DOUBLE AS w, (150 + c_custkey % 40)::DOUBLE AS h, (20 + c_custkey % 45)::DOUBLE AS g, c_custkey % 2 = 1 AS m FROM customer), "
    "e AS (SELECT *, (w * 10e0 + h * 6.25e0 - g * 5e0 + CASE WHEN m THEN 5e0 ELSE -161e0 END) * a AS kcal FROM c) SELECT c_custkey, "
    + ", ".join(f"{S(x)} AS {n}" for n, x in (("calories", "kcal"), ("protein_g", "w * 0.75e0"), ("carbs_g", "kcal * 0.50e0 / 4e0"), ("fat_g", "kcal * 0.35e0 / 9e0"), ("satfat_g", "kcal * 0.11e0 / 9e0"), ("sugar_g", "kcal * 0.05e0 / 4e0"), ("sodium_mg", "2400e0"))) + " FROM e",
    "slot_shares_fixed": "WITH " + C.PROFILES_SQL + f"SELECT profile_id, slot, {S('d_calories * share')} AS kcal FROM daily, (VALUES ('breakfast', 0.25e0), ('lunch', 0.35e0), ('dinner', 0.4e0)) v(slot, share)",
    "slot_allowance": "WITH " + C.PROFILES_SQL + "SELECT profile_id, " + ", ".join(f"{S(f'greatest(d_{n} - d_{n} * {f}e0, 0e0)')} AS {n}" for n, f in zip(N.NUTRIENTS, (0.5, 0.7, 0.4, 1.2, 0.9, 0.3, 0.6), strict=True)) + " FROM daily",
    "servings": SCORED_SQL + "SELECT profile_id, helpings, count(*) AS n FROM scored GROUP BY 1, 2",
    "penalties": SCORED_SQL + "SELECT profile_id, id, " + ", ".join(f"{S(n)} AS {n}" for n in ("energy", "macros", "repetition", "time")) + " FROM scored",
    "soft_gates": SCORED_SQL + "SELECT profile_id, " + ", ".join(f"count(*) FILTER ({_gates(i)}) AS level_{i}" for i in range(5)) + " FROM scored GROUP BY 1",
    "relevance_scaled": SCORED_SQL + ", " + _admitted_sql() + f" SELECT profile_id, id, {S('relevance')} AS relevance FROM admitted",
    "combine_topk": SCORED_SQL + ", " + _admitted_sql() + " SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, id)::INTEGER AS rn, id, score, helpings FROM admitted " + _TOP.format(k=10),
    "contributions": SCORED_SQL + ", " + _admitted_sql() + f" SELECT profile_id, id, {S('relevance * 1e0')} AS term_relevance, " + ", ".join(f"{S(f'{n} * -{N.WEIGHTS[n]}e0')} AS term_{n}" for n in ("energy", "macros", "repetition", "time")) + " FROM admitted " + _TOP.format(k=1),
    "relax_levels": SCORED_SQL + ", " + ", ".join(_admitted_sql(i, f"a{i}") for i in range(5)) + " " + " UNION ALL ".join(f"(SELECT {i}::INTEGER AS level, profile_id, id, score FROM a{i} {_TOP.format(k=1)})" for i in range(5)),
    "relax_note": "SELECT k::INTEGER AS level, CASE WHEN k > 0 THEN 'relaxed: ' || array_to_string(['time', 'repetition', 'macros', 'energy'][1:k], ', ') ELSE '' END AS note FROM range(5) r(k)",
    "sweep_ceiling": SCORED_SQL + "SELECT profile_id, weight, " + S(f"avg({_penalty_sql('weight')})", 3) + " AS mean_penalty FROM scored, (VALUES (0e0), (1e0), (2e0), (4e0)) v(weight) GROUP BY 1, 2",
    "sweep_main_share": "WITH " + C.PROFILES_SQL + ", " + C.ITEMS_SQL + f""", c AS (SELECT *, d_calories * 0.4e0 * share AS t FROM items, daily, (VALUES (0.55e0), (0.65e0), (0.75e0)) v(share) WHERE is_{SLOT} AND NOT is_side),
        s AS (SELECT *, {_servings_sql("t")} AS helpings FROM c), e AS (SELECT *, abs(helpings * calories - greatest(t, 1e0)) / greatest(t, 1e0) AS energy FROM s)
        SELECT profile_id, share, {S("min(energy)", 6)} AS least, {S("avg(energy)", 3)} AS mean FROM e GROUP BY 1, 2""",
    "hard_filter_report": _FILTER + "SELECT profile_id, failed, count(*) AS n FROM filtered GROUP BY 1, 2",
    "affordable": SCORED_SQL + "SELECT profile_id, count(*) AS n, count(*) FILTER (d_calories * 0.45e0 + greatest(helpings * calories, slot_kcal) + d_calories * 0.2e0 <= d_calories * 1.1e0) AS n_affordable FROM scored GROUP BY 1",
    "drift": "WITH " + C.PROFILES_SQL + ", n AS (SELECT profile_id, weight_kg + CASE WHEN profile_id % 4 = 0 THEN 1 ELSE 0 END AS w, CASE WHEN profile_id % 6 = 1 THEN 'nut' ELSE avoid END AS v FROM prof) "
    "SELECT profile_id, concat_ws(',', CASE WHEN p.weight_kg IS DISTINCT FROM w THEN 'weight_kg' END, CASE WHEN p.avoid IS DISTINCT FROM v THEN 'avoid' END) AS changed, p.avoid IS DISTINCT FROM v AS safety FROM prof p JOIN n USING (profile_id)",
    "plan_slot": SCORED_SQL + ", " + _admitted_sql() + f", top AS (SELECT * FROM admitted {_TOP.format(k=50)}), a AS (SELECT *, {S(_AHEAD, 6)} AS ahead FROM top) "
    f"SELECT profile_id, id, score, ahead, {S('score + ahead', 6)} AS final, helpings FROM a QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY {S('score + ahead', 6)} DESC, id) = 1",
}

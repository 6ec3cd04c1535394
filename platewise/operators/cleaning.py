"""Ordered rejection rules with attribution, tag sets, and nutrition columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.packed import NUMBERS, PHRASES, split_packed
from platewise.runtime import cut

#: Which tags place an item in a slot, which keep it out, and which make it a side.
SLOT_TAGS = {
    "breakfast": ("breakfast", "brunch", "breakfast-eggs", "oatmeal", "cereals-and-grains"),
    "lunch": ("lunch", "sandwiches", "salads", "soups-stews", "brown-bag", "lunch-snacks", "wraps"),
    "dinner": ("main-dish", "dinner-party", "meat", "poultry", "seafood", "pasta-rice-and-grains", "casseroles", "one-dish-meal", "roast-beef"),
}
EXCLUDED_TAGS = ("desserts", "beverages", "cocktails", "condiments-etc", "sauces", "dips", "salad-dressings", "spreads", "jams-and-preserves")
SIDE_TAGS = ("side-dishes", "vegetables", "greens", "potatoes", "rice", "beans")
SIDE_BREAKFAST_TAGS = ("fruit", "eggs-dairy", "cheese", "potatoes")
#: Order of the packed nutrition tuple, and the mass that 100 % of a daily value stands for.
NUTRIENTS = ("calories", "fat", "sugar", "sodium", "protein", "satfat", "carbs")
DAILY_VALUE = {"fat_g": 65.0, "sugar_g": 25.0, "sodium_mg": 2400.0, "protein_g": 50.0, "satfat_g": 20.0, "carbs_g": 300.0}


def any_of(tags: Column, wanted: tuple[str, ...]) -> Column:
    """Whether any of ``wanted`` is among ``tags``; false for null or empty tags."""
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False))


def with_nutrition(df: DataFrame, packed: str = "nutrition") -> DataFrame:
    """Seven nutrition columns of a packed tuple; all null unless it holds exactly seven numbers.

    Percentages of daily values become masses.
    """
    df = df.withColumn("__n", F.transform(split_packed(packed, NUMBERS), lambda x: x.try_cast("double")))
    whole = (F.size("__n") == len(NUTRIENTS)) & ~F.exists("__n", lambda x: x.isNull())
    at = {n: F.when(whole, F.col("__n")[i]) for i, n in enumerate(NUTRIENTS)}
    masses = {name: at[name.rsplit("_", 1)[0]] / 100.0 * ref for name, ref in DAILY_VALUE.items()}
    return df.withColumns({"calories": at["calories"], **masses}).drop("__n")


def with_tags(df: DataFrame, packed: str = "tags") -> DataFrame:
    """Replace the packed tags by an array (empty for null)."""
    return df.withColumn(packed, split_packed(packed, PHRASES))


def with_slots(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Slot flags, the exclusion flag, and the two side flags of an array of tags."""
    t = F.col(tags)
    flags = {f"in_{s}": any_of(t, w) for s, w in SLOT_TAGS.items()}
    return df.withColumns({**flags, "excluded": any_of(t, EXCLUDED_TAGS), "side_tagged": any_of(t, SIDE_TAGS), "side_breakfast": any_of(t, SIDE_BREAKFAST_TAGS)})


def item_rules() -> list[tuple[str, Column]]:
    """The nine rejection rules over nutrition and slot columns, in order of attribution."""
    c = F.col
    slotted = (c("in_breakfast") | c("in_lunch") | c("in_dinner")) & ~c("excluded")
    return [
        ("missing name", c("name").isNull()),
        ("malformed nutrition", c("calories").isNull()),
        ("no calories", c("calories") == 0),
        ("calories over 2000", c("calories") > 2000),
        ("no minutes", c("minutes") == 0),
        ("minutes over 1440", c("minutes") > 1440),
        ("fewer than 2 ingredients", c("n_ingredients") < 2),
        ("no steps", c("n_steps") < 1),
        ("no slot", ~slotted),
    ]


def first_rule(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that a row breaks, or null; an unknown outcome breaks no rule."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in rules))


def waterfall(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``(rule_no, rule, matched, newly)``: rows that each rule rejects, alone and after the earlier rules.

    One scan with conditional counts; no window and no pass per rule.
    """
    before, aggregates = F.lit(False), []
    for i, (_, c) in enumerate(rules):
        hit = F.coalesce(c, F.lit(False))
        aggregates += [F.count_if(hit).alias(f"m{i}"), F.count_if(hit & ~before).alias(f"n{i}")]
        before = before | hit
    one = df.agg(*aggregates)
    entries = [F.struct(F.lit(i + 1).alias("rule_no"), F.lit(name).alias("rule"), F.col(f"m{i}").alias("matched"), F.col(f"n{i}").alias("newly")) for i, (name, _) in enumerate(rules)]
    return one.select(F.inline(F.array(*entries)))


def side_pool(df: DataFrame) -> DataFrame:
    """Rows that only the slot rule rejects, tagged as sides and not excluded."""
    rules = item_rules()
    others = F.lit(False)
    for _, c in rules[:-1]:
        others = others | F.coalesce(c, F.lit(False))
    return df.where(~others & F.coalesce(rules[-1][1], F.lit(False)) & F.col("side_tagged") & ~F.col("excluded"))


def normalise(df: DataFrame, key: str, items: str, mapping: DataFrame, raw: str = "raw_ingr", entry: str = "replaced", sent: int = 500_000, salts: int = 64) -> DataFrame:
    """``(key, norm array<string>, has_unmappable boolean)`` of arrays of entered strings.

    A string becomes the canonical form of its trimmed lower-case form, or stays as
    that if the mapping does not know it, which marks the row.  Null arrays give an
    empty list; null items are dropped.  A mapping of at most ``sent`` counted strings
    goes to every task, so items are looked up where they are; of a larger one only the
    strings in use are looked up, and a string in many rows is spread over salts.
    """
    known = (
        mapping.where(F.col(entry).isNotNull())
        .select(F.explode(F.array(F.struct(F.lower(raw).alias("k"), F.lower(entry).alias("v"), F.lit(0).alias("o")), F.struct(F.lower(entry).alias("k"), F.lower(entry).alias("v"), F.lit(1).alias("o")))).alias("e"))
        .select("e.*")
        .where("k is not null")
        .groupBy("k")
        .agg(F.min(F.struct("o", "v"))["v"].alias("v"))
    )
    rows = df.select(F.col(key).alias("__key"), F.posexplode_outer(items).alias("pos", "item")).withColumn("k", F.lower(F.trim("item")))
    known = cut(known)
    if known.limit(sent + 1).count() <= sent:
        looked = rows.join(F.broadcast(known), "k", "left")
    else:
        salt = F.pmod(F.xxhash64("__key", "pos"), F.lit(salts)).cast("int")
        used = known.join(rows.select("k").distinct(), "k", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        looked = rows.withColumn("salt", salt).join(used, ["k", "salt"], "left")
    out = looked.groupBy("__key").agg(
        F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("pos", F.coalesce("v", "k").alias("x"))))).alias("xs"),
        F.count_if(F.col("item").isNotNull() & F.col("v").isNull()).alias("left"),
    )
    return out.select(F.col("__key").alias(key), F.transform("xs", lambda x: x["x"]).alias("norm"), (F.col("left") > 0).alias("has_unmappable"))


def reconcile(actual: DataFrame, expected: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """``(label, actual, expected, agrees)`` of two tables of totals; a missing side does not agree."""
    a = actual.select(F.col(label).alias("label"), F.col(value).alias("actual"))
    b = expected.select(F.col(label).alias("label"), F.col(value).alias("expected"))
    both = a.join(b, "label", "full_outer")
    return both.withColumn("agrees", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))

"""All pairs of records whose value sets are similar, by an adaptive extended-prefix join.

Sets are ordered by one global order, frequent values last.  Two sets of sizes ``n``
and ``m`` are similar if they share ``o = ceil((n + m) t / (1 + t))`` values; then for
each ``l`` up to ``o`` the first ``l`` values that they share lie among the first
``n - o + l`` of one and ``m - o + l`` of the other.  The join key of a set is therefore
a combination of ``l`` of its prefix values.

How long the combination is adapts to the data, combination by combination: the
pairs that a combination would bring are compared with the rows that its extensions
by one further value would cost (:data:`ROW_COST` pairs each), and it is extended
where that is cheaper, at every length anew until nothing is left to extend.  Both
sides of a pair follow the same counts, so no pair is lost: only sets that need no
further common value to be similar are also joined as they are.  Combinations that
one set alone holds vanish at once.

Inside the join a pair must pass the two prefix bounds and a bound from 128 parity
bits of each set, which differ in no more bits than the sets do in values.  What is
left is verified by its exact overlap in whole numbers.  Exact copies are collapsed
to one representative beforehand, so a group of copies costs one set.  Groups of
more than :data:`BLOCK` sets are joined in blocks, whatever their length.

Defined results: a null id or value is ignored, a value counts once in its set, an
empty set is similar to none, and a repeated id has the values of all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.runtime import cut, free

#: pairs of one group that may be compared at the cost of one row of a longer combination
ROW_COST = 32
#: sets of one group that one task compares with each other at a time
BLOCK = 4096


def _least(n: Column, num: int, den: int) -> Column:
    """Values that two sets of ``n`` values together must share."""
    return F.floor((n * num + (num + den - 1)) / (num + den)).cast("int")


def records(df: DataFrame, key: str, values: Column | str) -> DataFrame:
    """``(id, vals)``: each record's set as a sorted array, of the arrays ``values``.

    Only ids that occur more than once are grouped, so the others never move; they
    are told apart before ``values`` is computed, so each row's values are computed once.
    """
    often = cut(df.select(F.col(key).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))

    def sets(rows: DataFrame) -> DataFrame:
        vals = rows.select("__id", (F.col(values) if isinstance(values, str) else values).alias("vals"))
        return vals.select(F.col("__id").alias("id"), F.sort_array(F.array_distinct(F.array_compact("vals"))).alias("vals")).where("id is not null and size(vals) > 0")

    keyed = df.withColumn("__id", F.col(key))
    many = sets(keyed.join(often, keyed["__id"] == often["id"], "left_semi")).groupBy("id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("vals")))).alias("vals"))
    return sets(keyed.join(often, keyed["__id"] == often["id"], "left_anti")).unionByName(many)


def classes(values: DataFrame, key: str, value: str) -> DataFrame:
    """:func:`by_content` of ``values`` with a row per (record, value)."""
    sets = values.select(F.col(key).alias("id"), F.col(value).alias("val")).where("id is not null and val is not null")
    return by_content(sets.groupBy("id").agg(F.sort_array(F.collect_set("val")).alias("vals")))


def by_content(sets: DataFrame, least: int = 1) -> DataFrame:
    """``(id, rep, copies, vals, size)``: each set of ``least`` values or more, with the least id of its class of equal sets.

    Only the classes of several sets are joined back; a class may hold any share of all rows.
    """
    sized = sets.withColumn("size", F.size("vals")).where(F.col("size") >= least)
    held = cut(sized.withColumn("sig", F.unhex(F.sha2(F.to_json(F.struct("vals")), 256))))
    shared = cut(held.groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    return held.join(shared, "sig", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"), "vals", "size")


def _ordered(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``(id, size, free, low, high, hs)``: hashed values in the global order, frequent last, and 128 parity bits."""
    tokens = sets.select("id", "size", F.explode("vals").alias("val"))
    counts = cut(tokens.groupBy("val").agg(F.count("*").alias("df")).where("df > 1"))
    h = F.xxhash64("val")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    coded = tokens.join(counts, "val", "left").select("id", "size", F.coalesce("df", F.lit(1)).alias("df"), h.alias("h"))
    # values that only one set holds come first in the order
    return coded.groupBy("id", "size").agg(
        F.bit_xor(F.when(F.expr("h & 64") == 0, bit).otherwise(F.lit(0).cast("long"))).alias("low"),
        F.bit_xor(F.when(F.expr("h & 64") != 0, bit).otherwise(F.lit(0).cast("long"))).alias("high"),
        F.transform(F.sort_array(F.collect_list(F.struct("df", "h"))), lambda x: x["h"]).alias("hs"),
    ).withColumn("free", (F.col("size") - F.floor((F.col("size") * num + den - 1) / den)).cast("int"))


_ROW = ["key", "id", "size", "free", "low", "high", "pos"]


def _joined(rows: DataFrame, groups: DataFrame, depth: int, num: int, den: int, block: int, most: int) -> DataFrame:
    """Pairs ``(a, b)`` of sets with the same combination of ``depth`` values that pass all bounds."""
    rows = rows.join(groups, "key").select(*_ROW, "members")
    keys = ["key"]
    if most > block:
        salts = F.ceil(F.col("members") / block).cast("int")
        left = rows.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
        right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        keys.append("salt")
    else:
        left = right = rows
    l, r = left.alias("l"), right.alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    n, m = F.col("l.size"), F.col("r.size")
    least = _least(n + m, num, den)
    near = (F.col("l.pos") < n - least + depth) & (F.col("r.pos") < m - least + depth)
    differ = F.bit_count(F.col("l.low").bitwiseXOR(F.col("r.low"))) + F.bit_count(F.col("l.high").bitwiseXOR(F.col("r.high")))
    pairs = l.join(r, same & (F.col("l.id") < F.col("r.id")) & near & (differ <= n + m - least * 2))
    return pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def similar_pairs(sets: DataFrame, num: int = 4, den: int = 5, least: int = 1, row_cost: float = ROW_COST, block: int = BLOCK, trace: list | None = None) -> DataFrame:
    """``(a, b, common, size_a, size_b)``: distinct sets with Jaccard similarity >= num / den.

    ``sets`` is ``(id, vals)`` with distinct values, one row per set; sets of fewer
    than ``least`` values are left out.  ``a < b``.  ``trace`` is given a dict per
    length of combination: its groups, the pairs compared, and the groups extended;
    then one of the candidates that are verified.
    """
    sets = sets.select("id", "vals", F.size("vals").alias("size")).where(F.col("size") >= max(least, 1))
    keys = cut(_ordered(sets, num, den))
    rows = keys.select("id", "size", "free", "low", "high", F.posexplode(F.slice("hs", F.lit(1), F.col("free") + 1)).alias("pos", "key")).select(*_ROW)
    found, used, depth = [], [keys], 1
    while True:
        room = F.least(F.col("free") + depth, F.col("size") - 1) - F.col("pos")
        groups = cut(
            rows.groupBy("key").agg(F.count("*").alias("members"), F.sum(room).alias("rooms")).where("members > 1")
            .withColumn("deeper", (F.col("rooms") > 0) & (F.col("members") * (F.col("members") - 1) / 2 > F.col("rooms") * F.lit(float(row_cost))))
        )
        here = F.when(~F.col("deeper"), F.col("members"))
        stats = groups.agg(F.count("*").alias("groups"), F.sum(here * (here - 1) / 2).alias("pairs"), F.max(here).alias("most"), F.max("members").alias("all"), F.count_if("deeper").alias("extended")).first()
        if trace is not None:
            trace.append({"values": depth, "groups": stats["groups"], "compared": int(stats["pairs"] or 0), "extended": stats["extended"]})
        used.append(groups)
        if stats["groups"]:
            found.append(_joined(rows, groups.where("not deeper"), depth, num, den, block, stats["most"] or 0))
        if not stats["extended"]:
            break
        longer = groups.where("deeper")
        # sets so small that two of them may be similar by this many values alone
        if -(-max(least, 1) * num // den) <= depth:
            done = rows.where(F.col("size") - F.col("free") <= depth)
            found.append(_joined(done, longer, depth, num, den, block, stats["all"]))
        more = rows.join(longer.select("key"), "key").join(keys.select("id", "hs"), "id")
        after = F.slice("hs", F.col("pos") + 2, F.least(F.col("free") + depth, F.col("size") - 1) - F.col("pos"))
        more = more.select("key", "id", "size", "free", "low", "high", "pos", F.posexplode(after).alias("step", "h"))
        rows = cut(more.select(F.xxhash64("key", "h").alias("key"), "id", "size", "free", "low", "high", (F.col("pos") + 1 + F.col("step")).alias("pos")))
        used.append(rows)
        depth += 1
    if not found:
        none = sets.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
        found = [none]
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    candidates = cut(candidates.distinct())
    free(*used)
    if trace is not None:
        trace.append({"candidates": candidates.count()})
    one = sets.select(F.col("id").alias("a"), F.col("vals").alias("vals_a"))
    two = sets.select(F.col("id").alias("b"), F.col("vals").alias("vals_b"))
    verified = candidates.join(one, "a").join(two, "b").select(
        "a", "b", F.size(F.array_intersect("vals_a", "vals_b")).alias("common"), F.size("vals_a").alias("size_a"), F.size("vals_b").alias("size_b")
    )
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    return verified.where(F.col("common") * den >= union * num)


def similar_between(left: DataFrame, right: DataFrame, num: int = 4, den: int = 5, least: int = 1, **options) -> DataFrame:
    """Similar pairs between two tables of ``(id, vals)``: ``(a, b, common, size_a, size_b)``.

    Copies are collapsed over both tables first; ``a`` is an id of ``left``, ``b`` of ``right``.
    """
    both = left.select(F.struct(F.lit(0).alias("side"), "id").alias("id"), "vals").unionByName(
        right.select(F.struct(F.lit(1).alias("side"), "id").alias("id"), "vals")
    )
    members = cut(by_content(both.select("id", F.sort_array(F.array_distinct(F.array_compact("vals"))).alias("vals")), max(least, 1)))
    reps = members.where("id = rep").select("id", "vals")
    pairs = similar_pairs(reps, num, den, least, **options)
    same = reps.select(F.col("id").alias("a"), F.col("id").alias("b"), *(F.size("vals").alias(c) for c in ("common", "size_a", "size_b")))
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "common", F.col("size_b").alias("size_a"), F.col("size_a").alias("size_b"))
    links = pairs.unionByName(turned).unionByName(same)
    one = _opened(links, members.where("id.side = 0"), "a", keep_rep=False).withColumnRenamed("x", "p")
    two = _opened(one, members.where("id.side = 1"), "b", keep_rep=False)
    return two.select(F.col("p.id").alias("a"), F.col("x.id").alias("b"), "common", "size_a", "size_b")


def _opened(pairs: DataFrame, members: DataFrame, end: str, keep_rep: bool = True, block: int = BLOCK) -> DataFrame:
    """``pairs`` with a row per member ``x`` of the class at ``end``; a class of many copies is joined in blocks.

    With ``keep_rep`` a class of one is its own member and is not looked up.
    """
    salts = F.ceil(F.col("copies") / block).cast("int")
    held = members.select("id", "rep", "copies")
    if keep_rep:
        held = held.where("copies > 1")
    sizes = held.where("id = rep") if keep_rep else held.select("rep", "copies").distinct()
    salted = pairs.join(sizes.select(F.col("rep").alias(end), F.col("copies")), end, "left" if keep_rep else "inner")
    salted = salted.withColumn("salt", F.explode(F.when(F.col("copies").isNotNull(), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))))
    held = held.select(F.col("rep").alias(end), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.col("id").alias("x"))
    opened = salted.join(held, [end, "salt"], "left" if keep_rep else "inner")
    if keep_rep:  # a salt that no member of a class has drops out
        opened = opened.where("x is not null or copies is null").withColumn("x", F.coalesce("x", end))
    return opened.drop("salt", "copies")


def expand(members: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs of record ids behind class pairs and inside classes: ``(id_a, id_b)``, ``id_a < id_b``.

    Their number is the square of a class's copies; :func:`link_counts` is the answer that scales.
    """
    between = _opened(pairs.select("a", "b"), members, "a", block=block).select(F.col("x").alias("p"), "b")
    between = _opened(between, members, "b", block=block).select(F.col("p").alias("x"), F.col("x").alias("y"))
    shared = members.where("copies > 1").select("id", "rep", "copies")
    salts = F.ceil(F.col("copies") / block).cast("int")
    one = shared.select("rep", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.col("id").alias("x"))
    two = shared.select("rep", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("id").alias("y"))
    within = one.join(two, ["rep", "salt"]).where("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def link_counts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per record: ``(id, class_id, copies, links)``; links count similar records in other classes too.

    Copies are not expanded: a class's links are the copies of its partner classes
    plus its own other members.  Only classes with partners are joined.
    """
    sizes = members.where("id = rep").select("rep", "copies")
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    linked = cut(ends.join(sizes.select(F.col("rep").alias("other"), F.col("copies").alias("n")), "other").groupBy("rep").agg(F.sum("n").alias("partners")))
    counted = members.select("id", "rep", "copies").join(linked, "rep", "left")
    return counted.select("id", F.col("rep").alias("class_id"), "copies", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("links"))

"""Offline evaluation of rankings: holdout, hits, precision, recall, NDCG, diversity, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.ranks import numbered

CUTOFFS = (5, 10, 20)


def eligible_users(ratings: DataFrame, least: int = 10, least_positive: int = 5) -> DataFrame:
    """Users with enough ratings and enough of at least 4."""
    sizes = ratings.groupBy("user").agg(F.count("*").alias("n"), F.count_if(F.col("rating") >= 4).alias("positives"))
    return sizes.where((F.col("n") >= least) & (F.col("positives") >= least_positive))


def holdout(ratings: DataFrame, users: DataFrame, order: Column) -> DataFrame:
    """``(user, id)`` held out: a fifth of each user's positives, at least two, the first by ``order``."""
    positives = ratings.where("rating >= 4").join(users.select("user", "positives"), "user")
    take = F.greatest(F.lit(2), F.rint(F.col("positives") * 0.2).cast("int"))
    ranked = positives.withColumn("rn", F.row_number().over(Window.partitionBy("user").orderBy(order, "id")))
    return ranked.where(F.col("rn") <= take).select("user", "id")


def popular(train: DataFrame, most: int) -> DataFrame:
    """``(id, pop_rank)`` of the ``most`` most rated items, ties by id: a top-k, then range-partitioned ranks of its rows."""
    counts = train.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(most)
    return numbered(counts, [F.desc("n"), F.col("id")], "pop_rank").select("id", "pop_rank")


def popularity_hits(train: DataFrame, held: DataFrame, cutoff: int = max(CUTOFFS)) -> DataFrame:
    """``(user, id, rank0)`` of held-out items in the popularity list without the items the user has rated.

    No list is built per user: an item's place in it is its global place less the
    user's rated items before it, and nobody's list reaches beyond the longest
    history plus the cutoff.
    """
    users = held.select("user").distinct()
    seen = train.join(users, "user", "left_semi").select("user", "id")
    longest = seen.groupBy("user").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ranks = popular(train, longest + cutoff)
    both = seen.withColumn("held", F.lit(0)).unionByName(held.withColumn("held", F.lit(1))).join(ranks, "id")
    before = Window.partitionBy("user").orderBy("pop_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("seen_before", F.coalesce(F.sum(1 - F.col("held")).over(before), F.lit(0)))
    return placed.where("held = 1").select("user", "id", (F.col("pop_rank") - 1 - F.col("seen_before")).alias("rank0")).where(F.col("rank0") < cutoff)


def shuffled_hits(catalogue: DataFrame, train: DataFrame, held: DataFrame, order: Column, shift: Column, cutoff: int = max(CUTOFFS)) -> DataFrame:
    """``(user, id, rank0)`` of held-out items in a random list of all items ``(id)`` without those the user has rated.

    All lists are one circle of the items, in the order of ``order`` and the id, and each
    user's begins at ``shift`` of it: an item's place is arithmetic, and no list is built.
    """
    n = catalogue.count()
    places = numbered(catalogue.select("id"), [order, F.col("id")], "place")
    users = held.select("user").distinct()
    seen = train.join(users, "user", "left_semi").select("user", "id")
    both = seen.withColumn("held", F.lit(0)).unionByName(held.select("user", "id").withColumn("held", F.lit(1))).join(places, "id")
    both = both.withColumn("at", F.pmod(F.col("place") - 1 - shift, F.lit(max(n, 1))))
    before = Window.partitionBy("user").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("seen_before", F.coalesce(F.sum(1 - F.col("held")).over(before), F.lit(0)))
    return placed.where("held = 1").select("user", "id", (F.col("at") - F.col("seen_before")).alias("rank0")).where(F.col("rank0") < cutoff)


def list_hits(lists: DataFrame, held: DataFrame) -> DataFrame:
    """``(user, id, rank0)`` of held-out items in ranked lists ``(user, rn, id)``."""
    return lists.join(held.select("user", "id"), ["user", "id"]).select("user", "id", (F.col("rn") - 1).alias("rank0"))


def metrics(hits: DataFrame, held: DataFrame, groups: DataFrame | None = None, cutoffs=CUTOFFS) -> DataFrame:
    """Mean precision, recall and NDCG at each cutoff over all users with held-out items.

    ``groups`` is ``(user, population)``; without it all users are one population.
    """
    relevant = held.groupBy("user").agg(F.count("*").alias("n"))
    per_user = relevant.join(hits, "user", "left")
    gain = 1.0 / F.log2(F.col("rank0") + 2.0)
    sums = []
    for k in cutoffs:
        inside = F.col("rank0") < k
        sums += [F.count_if(inside).alias(f"h{k}"), F.coalesce(F.sum(F.when(inside, gain)), F.lit(0.0)).alias(f"d{k}")]
    per_user = per_user.groupBy("user", "n").agg(*sums)
    if groups is None:
        per_user = per_user.withColumn("population", F.lit("all"))
    else:
        per_user = per_user.join(groups, "user", "left")
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h"), F.col(f"d{k}").alias("d")) for k in cutoffs))
    rows = per_user.select("population", "user", "n", F.inline(entries))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", "k").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    rows = rows.withColumns({"precision": F.col("h") / F.col("k"), "recall": F.col("h") / F.col("n"), "ndcg": F.col("d") / ideal})
    return rows.groupBy("population", "k").agg(F.count("*").alias("users"), *(F.avg(m).alias(m) for m in ("precision", "recall", "ndcg")))


def system_metrics(systems: dict[str, DataFrame], held: DataFrame, groups: DataFrame | None = None, cutoffs=CUTOFFS) -> DataFrame:
    """:func:`metrics` of several systems' hits, with their names in ``system``.

    The hits of all systems are summed up together, and only users with hits meet their
    number of held-out items; the others count with zeros.
    """
    relevant = held.groupBy("user").agg(F.count("*").alias("n"))
    relevant = relevant.withColumn("population", F.lit("all")) if groups is None else relevant.join(groups, "user", "left")
    hits = None
    for name, found in systems.items():
        one = found.select(F.lit(name).alias("system"), "user", "rank0")
        hits = one if hits is None else hits.unionByName(one)
    gain, sums = 1.0 / F.log2(F.col("rank0") + 2.0), []
    for k in cutoffs:
        inside = F.col("rank0") < k
        sums += [F.count_if(inside).alias(f"h{k}"), F.coalesce(F.sum(F.when(inside, gain)), F.lit(0.0)).alias(f"d{k}")]
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h"), F.col(f"d{k}").alias("d")) for k in cutoffs))
    rows = hits.groupBy("system", "user").agg(*sums).join(relevant, "user").select("system", "population", "n", F.inline(entries))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", "k").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    rows = rows.withColumns({"precision": F.col("h") / F.col("k"), "recall": F.col("h") / F.col("n"), "ndcg": F.col("d") / ideal})
    totals = rows.groupBy("system", "population", "k").agg(*(F.sum(m).alias(m) for m in ("precision", "recall", "ndcg")))
    every = F.array(*(F.struct(F.lit(name).alias("system"), F.lit(k).alias("k")) for name in systems for k in cutoffs))
    users = relevant.groupBy("population").agg(F.count("*").alias("users")).select("population", "users", F.inline(every))
    joined = users.alias("u").join(totals.alias("t"), (F.col("u.system") == F.col("t.system")) & (F.col("u.k") == F.col("t.k")) & F.col("u.population").eqNullSafe(F.col("t.population")), "left")
    return joined.select("u.system", "u.population", "u.k", "users", *((F.coalesce(m, F.lit(0.0)) / F.col("users")).alias(m) for m in ("precision", "recall", "ndcg")))


def dissimilarity(lists: DataFrame, group: str, items: str, order: str) -> DataFrame:
    """``(group, ild)``: mean of 1 - Jaccard over the unordered pairs of each group's sets; 0 for empty pairs.

    Groups are lists of recommendations, a few dozen rows each; pairs are formed
    inside the row that holds a list, without a join.
    """
    packed = lists.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, F.array_distinct(items).alias("s")))).alias("xs"))

    def distance(a: Column, b: Column) -> Column:
        union = F.size(F.array_union(a, b))
        return F.when(union == 0, F.lit(0.0)).otherwise(1.0 - F.size(F.array_intersect(a, b)) / union)

    n = F.size("xs")
    pairs = F.flatten(F.transform(F.col("xs"), lambda x, i: F.transform(F.slice("xs", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: distance(x["s"], y["s"]))))
    return packed.select(group, F.explode(pairs).alias("d")).groupBy(group).agg(F.avg("d").alias("ild"))


def coverage(picks: DataFrame, item: str, n_items: int) -> DataFrame:
    """Distinct items, their share of the catalogue, share of the most used, and items used once."""
    used = picks.groupBy(item).agg(F.count("*").alias("n"))
    return used.agg(
        F.count("*").alias("distinct_items"), (F.count("*") / F.lit(max(n_items, 1))).alias("coverage"),
        F.try_divide(F.max("n").cast("double"), F.sum("n")).alias("top_share"), F.count_if(F.col("n") == 1).alias("used_once"),
    )

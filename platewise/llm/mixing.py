"""Mix sources to target weights with capped repetition, by a min-cost flow over membership patterns.

Documents that belong to the same set of listed sources form a pattern.  Only the
patterns' total sizes reach the driver, at most :data:`PATTERNS` of them.  Flow runs from each pattern, at a cost that rises with every
repetition of its documents, through its sources to their quotas; the cheapest
maximum flow meets the quotas as far as the repeat caps allow with the fewest
repetitions.

Documents are then selected by place: a seeded hash orders a pattern's documents
on a circle whose length is their total size, and each source takes an arc as
long as its flow.  A document is used as often as the arc passes its start, so
never more than ``ceil(flow / total)`` times.  Places are exact prefix sums in
two steps (buckets, then inside a bucket), so no task holds a whole source.  A few
uses more or less of the best fitting documents then close the gaps that whole
documents leave.

Defined results: sources compare trimmed and in lower case; documents of unlisted
or null sources take no part; documents of size 0 are never used; a null
``max_repeats`` means 1 and a null weight 0; targets repeated in the table add up.
More than :data:`PATTERNS` sets of sources, or a thousand targets, raise an error.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.runtime import at_most, cut

BUCKETS = 4096
#: most membership patterns, each a row on the driver; more are refused
PATTERNS = 1 << 16
#: repetitions with a cost of their own; further ones are priced in blocks that double, each at its first
EXACT_USES = 64
#: passes that bring the sources nearer to their quotas
ROUNDS = 3


@dataclass
class Target:
    weight: float
    max_repeats: int


class Flow:
    """Cheapest maximum flow by successive shortest paths with potentials, on whole numbers."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        high = [0] * len(self.out)
        while True:
            far: list[float] = [float("inf")] * len(self.out)
            via = [-1] * len(self.out)
            far[source], queue = 0, [(0, source)]
            while queue:
                d, x = heapq.heappop(queue)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    step = d + self.cost[e] + high[x] - high[self.to[e]]
                    if self.room[e] and step < far[self.to[e]]:
                        far[self.to[e]], via[self.to[e]] = step, e
                        heapq.heappush(queue, (step, self.to[e]))
            if far[sink] == float("inf"):
                return
            high = [h + (f if f < float("inf") else far[sink]) for h, f in zip(high, far, strict=True)]
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push


def route(sizes: dict[tuple[str, ...], int], targets: dict[str, Target], total: int | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each of its sources."""
    total = sum(sizes.values()) if total is None else total
    patterns, sources = sorted(p for p in sizes if p), sorted(targets)
    flow = Flow(2 + len(patterns) + len(sources))
    place = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    arcs = {}
    for i, p in enumerate(patterns):
        use, most, step = 0, sum(targets[s].max_repeats for s in p), 1
        while use < most:
            step = 1 if use < EXACT_USES else min(step * 2, most - use)
            flow.arc(0, 2 + i, sizes[p] * step, use)
            use += step
        for s in p:
            arcs[p, s] = flow.arc(2 + i, place[s], sizes[p] * targets[s].max_repeats, 0)
    for s in sources:
        flow.arc(place[s], 1, round(targets[s].weight * total), 0)
    flow.run(0, 1)
    return {k: flow.room[e ^ 1] for k, e in arcs.items()}


def read_targets(df: DataFrame, most: int = 1000) -> dict[str, Target]:
    """Targets of a table ``(source, weight, max_repeats)`` of a few rows."""
    rows = at_most(df.select("source", "weight", "max_repeats"), most)
    if rows is None:
        raise ValueError(f"more than {most} target sources")
    out: dict[str, Target] = {}
    for r in rows:
        name = (r["source"] or "").strip().lower()
        if not name:
            continue
        repeats = 1 if r["max_repeats"] is None else max(0, int(r["max_repeats"]))
        t = out.setdefault(name, Target(0.0, repeats))
        t.weight += r["weight"] or 0.0
        t.max_repeats = max(t.max_repeats, repeats)
    return out


def normal_source(column: str):
    """Trimmed lower-case source name."""
    return F.lower(F.trim(F.col(column)))


def _places(sized: DataFrame, seed: int) -> DataFrame:
    """Add ``place``: the total size of the documents before this one in its pattern's seeded order."""
    h = F.xxhash64(F.lit(seed), F.col("id"))
    sized = sized.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    buckets = sized.groupBy("pattern", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("pattern", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(buckets, ["pattern", "bucket"])
    return placed.withColumn("place", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def _closer(uses: DataFrame, quotas: dict[str, int], rounds: int = ROUNDS) -> DataFrame:
    """Bring each source nearer its quota by one use more or less of one document, ``rounds`` times.

    Each round is one pass that keeps one row per source.
    """
    spark, made = uses.sparkSession, {}
    gaps = {s: q for s, q in quotas.items()}
    for r in uses.groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("t")).collect():
        gaps[r["source"]] -= r["t"]

    def changed() -> DataFrame:
        if not made:
            return uses
        kinds = f"source string, id {uses.schema['id'].dataType.simpleString()}, change int"
        table = spark.createDataFrame([(s, i, c) for (s, i), c in made.items()], kinds)
        # at most one row per source and round
        joined = uses.join(F.broadcast(table), ["source", "id"], "left")
        return joined.select("id", "source", "size", "cap", (F.col("uses") + F.coalesce("change", F.lit(0))).alias("uses"))

    for _ in range(rounds):
        open_ = [(s, g) for s, g in gaps.items() if g]
        if not open_:
            break
        tried = changed().join(F.broadcast(spark.createDataFrame(open_, "source string, gap long")), "source")  # a row per source
        change = F.when((F.col("gap") > 0) & (F.col("uses") < F.col("cap")), F.lit(1)).when((F.col("gap") < 0) & (F.col("uses") > 0), F.lit(-1))
        left = F.abs(F.col("gap") - F.col("change") * F.col("size"))
        tried = tried.withColumn("change", change).where(F.col("change").isNotNull()).withColumn("left", left).where(F.col("left") < F.abs("gap"))
        best = tried.groupBy("source").agg(F.min(F.struct("left", "id", "size", "change")).alias("b")).select("source", "b.*").collect()
        if not best:
            break
        for r in best:
            made[r["source"], r["id"]] = made.get((r["source"], r["id"]), 0) + r["change"]
            gaps[r["source"]] -= r["change"] * r["size"]
    return changed()


def mix(documents: DataFrame, targets: dict[str, Target], seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """``(uses, report)`` for documents ``(id, sources array<string>, size long)``.

    ``uses`` is ``(id, source, size, uses)`` with a row per used document and source;
    ``report`` has a row per target with its target and actual tokens and shares, of
    the total size of the documents of listed sources and of the resulting mix.
    """
    spark = documents.sparkSession
    listed = F.array(*(F.lit(s) for s in sorted(targets))) if targets else F.array().cast("array<string>")
    sized = documents.select("id", F.array_sort(F.array_intersect(F.coalesce("sources", F.array().cast("array<string>")), listed)).alias("pattern"), "size")
    # sizes may be costly to compute: they are written before they are filtered by, so they are computed once
    sized = cut(sized.where("size(pattern) > 0")).where("size > 0")
    patterns = at_most(sized.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("size").alias("t")), PATTERNS)
    if patterns is None:
        raise ValueError(f"more than {PATTERNS} sets of sources")
    sums = {tuple(r["pattern"]): (r["n"], r["t"]) for r in patterns}
    total = sum(t for _, t in sums.values())
    given = route({p: t for p, (_, t) in sums.items()}, targets)
    arcs, start = [], dict.fromkeys(sums, 0)
    for (p, s), f in sorted(given.items()):
        if f:
            arcs.append((list(p), s, sums[p][1], start[p], f, targets[s].max_repeats))
            start[p] += f
    arcs_df = spark.createDataFrame(arcs, "pattern array<string>, source string, length long, start long, flow long, cap int")

    def passes(x):  # starts of a document on the unrolled circle before x
        return F.when(x <= F.col("place"), F.lit(0)).otherwise(F.expr("1") + F.floor((x - F.col("place") - 1) / F.col("length")))

    # a broadcast of at most one row per pattern, of which there are at most PATTERNS, and source
    placed = _places(sized, seed).join(F.broadcast(arcs_df), "pattern")
    uses = placed.select("id", "source", "size", "cap", (passes(F.col("start") + F.col("flow")) - passes(F.col("start"))).cast("int").alias("uses"))
    uses = cut(uses)
    uses = _closer(uses, {s: round(t.weight * total) for s, t in targets.items()})
    rows = [
        (s, t.weight, t.max_repeats, round(t.weight * total), sum(n for p, (n, _) in sums.items() if s in p), sum(x for p, (_, x) in sums.items() if s in p))
        for s, t in sorted(targets.items())
    ]
    plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, target_tokens long, documents long, available_tokens long")
    got = uses.groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("t"), F.max("uses").alias("most_uses"), F.count_if(F.col("uses") > 0).alias("used_documents"))
    whole = max(total, 1)
    report = plan.join(got, "source", "left").withColumn("actual_tokens", F.coalesce("t", F.lit(0)))
    mixed = F.greatest(F.sum("actual_tokens").over(Window.partitionBy()), F.lit(1))  # one row per target
    report = report.select(
        "source", "target_share", (F.col("actual_tokens") / whole).alias("actual_share"), (F.col("actual_tokens") / mixed).alias("share_of_mix"),
        "target_tokens", "actual_tokens", "available_tokens", "documents", F.coalesce("used_documents", F.lit(0)).alias("used_documents"),
        "max_repeats", F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    return uses.where("uses > 0").select("id", "source", "size", "uses"), report

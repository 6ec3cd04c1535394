import random
from collections import Counter
from itertools import combinations

import pytest

from platewise.llm import cooccurrence as C

random.seed(4)
ITEMS = [f"é{i}" if i % 5 == 0 else f"i{i}" for i in range(60)]
ROWS = [(k, [random.choice(ITEMS[: 1 + int(random.expovariate(0.08)) % 60]) for _ in range(random.randint(0, 9))] + ["hot"] * (k % 3 == 0) + [None] * (k % 7 == 0)) for k in range(700)]
ROWS += [(1000, None), (1001, []), (1002, [None]), (1003, ["same", "same"])]


def brute(rows, least, per_mille):
    sets = [sorted({x for x in r if x is not None}, key=lambda s: s.encode()) for _, r in rows if r]
    n = sum(bool(r) for _, r in rows)
    one = Counter(x for s in sets for x in s)
    two = Counter(p for s in sets for p in combinations(s, 2))
    return {(a, b, c, one[a], one[b], n) for (a, b), c in two.items() if c >= least and 1000 * c >= per_mille * n}


@pytest.mark.parametrize("options", [{}, {"max_heavy": 1}, {"max_heavy": 100_000}, {"dictionary": 3}, {"min_count": 4, "per_mille": 10}, {"min_count": 4, "dictionary": 2}])
def test_equals_brute_force(spark, options):
    df = spark.createDataFrame(ROWS, "item_a long, xs array<string>").repartition(3)
    got = {tuple(r)[:6] for r in C.frequent_pairs(df, "xs", **options).collect()}
    assert got == brute(ROWS, options.get("min_count", 1), options.get("per_mille", 0))


def test_small_blocks_add_up(spark):
    df = spark.createDataFrame(ROWS, "k long, xs array<string>").coalesce(1)
    got = {tuple(r) for r in C.pair_counts(df, "xs", ["hot", "i1"], block=64).collect()}
    assert got == {x[:3] for x in brute(ROWS, 1, 0)}


def test_lift_and_empty_tables(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "b"],), (["c"],), (["c"],)], "xs array<string>")
    assert C.frequent_pairs(df, "xs").first()["lift"] == 2.0
    assert C.frequent_pairs(df.limit(0), "xs").count() == 0 and C.frequent_pairs(df.limit(0), "xs", 5, 1).count() == 0


def test_one_long_record(spark):
    df = spark.createDataFrame([([f"x{i}" for i in range(900)],)], "xs array<string>")
    assert C.frequent_pairs(df, "xs").count() == 900 * 899 // 2

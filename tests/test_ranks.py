import random

import numpy as np
from pyspark.sql import functions as F

from platewise.operators import profiling as P
from platewise.operators import ranks as R


def test_ranks_equal_counting(spark):
    random.seed(8)
    rows = [(random.choice(["a", "b", None]), random.choice("xy"), random.choice([0.0, 0.0, random.random(), round(random.random(), 1)])) for _ in range(3000)] + [("a", "x", None)]
    df = spark.createDataFrame(rows, "before string, part string, value double")
    got = {(r[0], r[1], r["value"]): (r["same"], r["below"], r["total"]) for r in R.ranks(df.toDF("g", "s", "value"), ["g", "s"], partitions=5).collect()}
    assert len(got) == len({r for r in rows if r[2] is not None})
    for g, s, v in got:
        mine = [x for a, b, x in rows if (a, b) == (g, s) and x is not None]
        assert got[g, s, v] == (mine.count(v), sum(x < v for x in mine), len(mine))
    assert R.ranks(df.limit(0).toDF("g", "s", "value"), ["g"]).count() == 0


def test_numbers_follow_the_order(spark):
    rows = [(i, i * 7919 % 101) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, n long").repartition(7)
    got = {r["id"]: r["rank"] for r in R.numbered(df, [F.desc("n"), F.col("id")], partitions=6).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert R.numbered(df.limit(0), [F.col("id")]).count() == 0


def test_quantiles_equal_interpolation(spark):
    random.seed(3)
    xs = [random.choice([1.0, 1.0, 5.0, random.random() * 9]) for _ in range(501)]
    df = spark.createDataFrame([(x, None) for x in xs], "a double, b double")
    got = {(r["column_name"], r["share"]): r["value"] for r in P.quantiles(df, "a", "b", shares=(0.0, 0.1, 0.5, 0.733, 1.0)).collect()}
    assert len(got) == 10 and all(got["b", s] is None for s in (0.0, 0.5, 1.0))
    assert all(abs(got["a", s] - np.quantile(xs, s)) < 1e-12 for s in (0.0, 0.1, 0.5, 0.733, 1.0))

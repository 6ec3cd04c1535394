import numpy as np
import pytest

from platewise.operators import als, factors, ranking
from platewise.plans import recommend


def test_ridge_of_short_and_long_rows():
    rng = np.random.default_rng(1)
    q, sizes = rng.normal(size=(90, 6)).astype(np.float32), np.array([3, 1, 40, 6, 7, 700, 1], np.int32)
    at, y = rng.integers(0, 90, sizes.sum()).astype(np.int32), rng.normal(size=sizes.sum()).astype(np.float32)
    for cells in (500_000, 60):
        got, begin = als.ridge(sizes, at, y, q, 0.1, cells), np.cumsum(sizes) - sizes
        for v, a, n in zip(got, begin, sizes, strict=True):
            x = q[at[a : a + n]].astype(float)
            assert np.allclose(v, np.linalg.solve(x.T @ x + 0.1 * n * np.eye(6), x.T @ y[a : a + n]), atol=1e-5)


def ratings(spark):
    rng = np.random.default_rng(5)
    # ids beyond 32 bits, an item that half of the users have, users of one rating
    rows = sorted({(int(u) * 10**10, int(i)) for u, i in zip(rng.integers(0, 60, 500), rng.integers(0, 40, 500), strict=True)} | {(u * 10**10, 77) for u in range(0, 90, 2)})
    return spark.createDataFrame([(u, i, int(r)) for (u, i), r in zip(rows, rng.integers(1, 6, len(rows)), strict=True)], "user long, id long, rating int")


def test_vectors_are_those_of_direct_solves(spark):
    df = ratings(spark)
    rows, rank = [tuple(r) for r in df.collect()], 3
    bias = {r["id"]: r["bi"] for r in factors.biases(df)[1].collect()}
    mine = {r["user"]: r["bu"] for r in factors.biases(df)[2].collect()}
    mu = np.mean([r for _, _, r in rows])
    rest = [(u, i, r - mu - bias[i] - mine[u]) for u, i, r in rows]
    found = {}
    for iterations in (1, 2):
        q, p = als.train(df, rank, iterations, 0.1, 5.0, 17, 10**6)
        found[iterations] = {r["id"]: np.array(r["q"]) for r in q.collect()}, {r["user"]: np.array(r["p"]) for r in p.collect()}

    def solve(y, keys, other):
        x = np.array([other[k] for k in keys])
        return np.linalg.solve(x.T @ x + 0.1 * len(y) * np.eye(rank), x.T @ y)

    for n, (q, p) in found.items():
        for user, v in p.items():
            own = [(i, y) for u, i, y in rest if u == user]
            assert np.allclose(v, solve([y for _, y in own], [i for i, _ in own], q), atol=1e-5)
        if n == 2:
            for item, v in q.items():
                own = [(u, y) for u, i, y in rest if i == item]
                assert np.allclose(v, solve([y for _, y in own], [u for u, _ in own], found[1][1]), atol=1e-5)


def test_vectors_do_not_depend_on_the_shares(spark):
    df, key = ratings(spark), "spark.sql.shuffle.partitions"
    before, found = spark.conf.get(key), []
    try:
        for parts in ("1", "7"):
            spark.conf.set(key, parts)
            found.append({r["user"]: r["p"] for r in als.train(df, 3, 4, 0.1, 5.0, 17, 10**6)[1].collect()})
    finally:
        spark.conf.set(key, before)
    assert found[0].keys() == found[1].keys() and all(np.allclose(found[0][u], found[1][u], atol=1e-4) for u in found[0])
    assert als.train(df.limit(0), 3, 4, 0.1, 5.0, 17, 10**6) is None and als.train(df, 3, 4, 0.1, 5.0, 17, 100) is None


def test_factors_are_trained_without_messages(spark, data, monkeypatch):
    import pyspark.ml.recommendation

    def solver(*_, **__):
        raise AssertionError("each user's vector is sent to each block of items, in each iteration")

    monkeypatch.setattr(pyspark.ml.recommendation, "ALS", solver)
    assert {r["part"]: r["model_rmse"] < r["global_rmse"] for r in recommend.mf_train(spark, data).collect()}["train"]
    assert recommend.prf_systems(spark, data).count() == 15


@pytest.mark.parametrize("grouped", [False, True])
def test_metrics_of_systems_together(spark, grouped):
    held = spark.createDataFrame([(u, i) for u in range(6) for i in range(2 + u % 3)], "user long, id long")
    some = spark.createDataFrame([(0, 0, 3), (0, 1, 19), (4, 1, 0), (5, 0, 6)], "user long, id long, rank0 int")
    groups = spark.createDataFrame([(u, "a" if u < 2 else "b") for u in range(6) if u != 3], "user long, population string") if grouped else None
    systems = {"some": some, "none": some.limit(0)}
    got = {(r["system"], r["population"], r["k"]): r for r in ranking.system_metrics(systems, held, groups).collect()}
    want = {(name, r["population"], r["k"]): r for name, hits in systems.items() for r in ranking.metrics(hits, held, groups).collect()}
    assert got.keys() == want.keys()
    for key, r in want.items():
        assert got[key]["users"] == r["users"] and np.allclose([got[key][m] for m in ("precision", "recall", "ndcg")], [r[m] for m in ("precision", "recall", "ndcg")])
    assert ranking.system_metrics(systems, held.limit(0)).count() == 0

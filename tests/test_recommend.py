import numpy as np
import pytest
from oracle import compare, connect

from platewise.operators import content, factors
from platewise.plans import recommend


def test_fold_in_solves_on_whole_vectors(spark, data):
    q = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    customer = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{data}/orders.parquet").collect()}
    best = {}
    for r in spark.read.parquet(f"{data}/lineitem.parquet").collect():
        if r["l_orderkey"] in customer and r["l_partkey"] in q:
            key = customer[r["l_orderkey"]], r["l_partkey"]
            best[key] = max(best.get(key, 0), (r["l_quantity"] - 1) // 10 + 1)
    by = {}
    for (user, part), rating in best.items():
        by.setdefault(user, []).append((q[part], float(rating) - 3))
    got = {r["user"]: (r["bu"], r["p"]) for r in recommend.fold_in(spark, data).collect()}
    assert set(got) == set(by)
    for user, rows in by.items():
        m, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
        assert len(got[user][1]) == m.shape[1] == 64
        assert np.allclose(got[user][1], np.linalg.solve(m.T @ m + 0.1 * np.eye(64), m.T @ y), atol=2e-6) and np.isclose(got[user][0], y.mean(), atol=2e-6)


def test_fold_in_reduces_a_long_history(spark):
    rng = np.random.default_rng(4)
    m, y = rng.normal(size=(3000, 3)), rng.integers(1, 6, 3000).astype(float)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, q array<double>")
    ratings = spark.createDataFrame([(7, i, v) for i, v in enumerate(y.tolist())], "user long, id long, rating double")
    (row,) = factors.fold_in(ratings, items.selectExpr("id", "0D AS bi"), items, 3.0).collect()
    assert np.allclose(row["p"], np.linalg.solve(m.T @ m + 0.1 * np.eye(3), m.T @ (y - 3))) and np.isclose(row["bu"], y.mean() - 3)


def for_all(name):
    """The SQL of a query of the query set, without its filter."""
    assert recommend.SQL[name].count(' AND "user" % 100 = 0') == 1
    return recommend.SQL[name].replace(' AND "user" % 100 = 0', "")


def test_user_vector_all_has_every_user(spark, data):
    compare(connect(data), recommend.user_vector_all(spark, data), for_all("user_vector"))


def test_top10_support_all_is_over_every_user(spark, data):
    compare(connect(data), recommend.top10_support_all(spark, data), for_all("top10_support"))


@pytest.mark.parametrize("blocks", [{}, {"most_items": 30}, {"most_weights": 400}])
def test_cosine_top_of_all_users(spark, data, blocks):
    weights = recommend._weights(spark, data)
    best = content.cosine_top(weights, recommend._all_vectors(spark, data, weights), recommend.C.ratings(spark, data), 10, **blocks)
    compare(connect(data), best, for_all("cosine_topk"))


def test_cosine_top_with_zero_and_negative_scores(spark):
    w = spark.createDataFrame([(i, t, 0.5) for i in range(6) for t in (f"t{i}", f"t{i + 1}")] + [(9, "z", 1.0)], "id long, token string, w double")
    v = spark.createDataFrame([(1, "t1", -0.6), (1, "t2", 0.6), (1, "t5", -0.8), (2, "z", -1.0), (3, "none", 1.0)], "user long, token string, w double")
    seen = spark.createDataFrame([(1, 2), (2, 77)], "user long, id long")
    got = [tuple(r) for r in content.cosine_top(w, v, seen, 10).orderBy("user", "rn").collect()]
    assert got == [(1, 1, 1, 0.0), (1, 2, 0, -0.3), (1, 3, 4, -0.4), (1, 4, 5, -0.4), (2, 1, 9, -1.0)]
    assert content.cosine_top(w.limit(0), v, seen, 10).count() == 0 and content.cosine_top(w, v.limit(0), seen, 10).count() == 0


@pytest.mark.parametrize("name", ["cosine_topk", "top10_support"])
def test_query_set_makes_no_row_per_pair(spark, data, monkeypatch, name):
    def pairs(*_, **__):
        raise AssertionError("a row for each user and item")

    monkeypatch.setattr(content, "cosine", pairs)
    compare(connect(data), getattr(recommend, name)(spark, data), recommend.SQL[name])

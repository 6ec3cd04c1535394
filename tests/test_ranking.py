import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import content, factors, ranking

random.seed(3)
RATINGS = sorted({(u, i): (u, i, random.randint(0, 5)) for u, i in ((random.randint(1, 12), int(random.expovariate(0.15))) for _ in range(400))}.values())


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.createDataFrame(RATINGS, "user long, id long, rating int").cache()


def test_hits_and_metrics_equal_brute_force(spark, ratings):
    users = ranking.eligible_users(ratings)
    held = ranking.holdout(ratings, users, F.col("id") % 7)
    train = ratings.join(held, ["user", "id"], "left_anti")
    h = {}
    for r in held.collect():
        h.setdefault(r["user"], set()).add(r["id"])
    t = [(r["user"], r["id"]) for r in train.collect()]
    count = {}
    for _, i in t:
        count[i] = count.get(i, 0) + 1
    order = sorted(count, key=lambda i: (-count[i], i))
    want, sums = set(), {5: [], 10: [], 20: []}
    for u, items in h.items():
        listed = [i for i in order if (u, i) not in t][:20]
        want |= {(u, i, listed.index(i)) for i in items if i in listed}
        for k in sums:
            gains = [1 / math.log2(listed.index(i) + 2) for i in items if i in listed[:k]]
            sums[k].append((len(gains) / k, len(gains) / len(items), sum(gains) / sum(1 / math.log2(j + 2) for j in range(min(k, len(items))))))
    hits = ranking.popularity_hits(train, held)
    assert {tuple(r) for r in hits.collect()} == want
    for r in ranking.metrics(hits, held).collect():
        assert np.allclose([r["precision"], r["recall"], r["ndcg"]], np.mean(sums[r["k"]], axis=0))
    assert ranking.popularity_hits(train.limit(0), held.limit(0)).count() == 0


def test_fold_in_equals_a_direct_solve(spark, ratings):
    rng = np.random.default_rng(1)
    q = {i: rng.normal(size=4) for i in range(60)}
    factor = spark.createDataFrame([(i, v.tolist()) for i, v in q.items()], "id long, q array<double>")
    bias = spark.createDataFrame([(i, i / 100.0) for i in range(0, 60, 2)], "id long, bi double")
    got = {r["user"]: (r["bu"], r["p"]) for r in factors.fold_in(ratings, bias, factor, 3.0, 0.1).collect()}
    by = {}
    for u, i, r in RATINGS:
        if i in q:
            by.setdefault(u, []).append((q[i], r - 3.0 - (i / 100.0 if i % 2 == 0 else 0)))
    for u, rows in by.items():
        m, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
        assert np.allclose(got[u][1], np.linalg.solve(m.T @ m + 0.1 * np.eye(4), m.T @ y)) and np.isclose(got[u][0], y.mean())


def test_rating_direction(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "c"), (3, "b")], "id long, token string").withColumn("tf", F.lit(1))
    w = content.tfidf(tokens, 3)
    assert np.allclose([r["s"] for r in w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()], 1.0)
    score = {}
    for rating in (5, 3, 1):
        v = content.user_vectors(w, spark.createDataFrame([(9, 1, rating)], "user long, id long, rating int"))
        score[rating] = {r["id"]: r["score"] for r in content.cosine(w, v).collect()}
    assert score[5][1] > 0.99 and score[1][1] < -0.99 and score[3] == {}


def test_rank_items_breaks_ties_by_id(spark):
    items = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(6)], "id long, q array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0])], "user long, p array<double>")
    for few in (20_000, 0):
        assert [r["id"] for r in factors.rank_items(q, items, 4, few).orderBy("rn").collect()] == [1, 3, 5, 0]


def test_factor_model_fits_better_than_the_mean(spark):
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(40, 2)), rng.normal(size=(30, 2))
    rows = [(a, b, int(np.clip(round(3 + u[a] @ v[b]), 1, 5))) for a in range(40) for b in range(30) if (a + b) % 3]
    df = spark.createDataFrame(rows, "user long, id long, rating int")
    mu, item, user, q, p = factors.factorise(df, rank=4, iterations=5)
    fit = factors.predict(df, mu, item, user, q, p).agg(factors.rmse(F.col("rating"), F.col("predicted"))).first()[0]
    plain = factors.means(df, df).agg(factors.rmse(F.col("rating"), F.col("global_mean"))).first()[0]
    assert fit < 0.7 * plain


def test_dissimilarity_and_coverage(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "c", "c"]), (1, 3, []), (2, 1, ["a"])], "g long, o long, s array<string>")
    got = {r["g"]: r["ild"] for r in ranking.dissimilarity(df, "g", "s", "o").collect()}
    assert np.isclose(got[1], ((1 - 1 / 3) + 1 + 1) / 3) and 2 not in got
    c = ranking.coverage(df, "g", 10).first()
    assert (c["distinct_items"], c["coverage"], c["top_share"], c["used_once"]) == (2, 0.2, 0.75, 1)


def test_random_lists_by_place(spark):
    from pyspark.sql import functions as F

    from platewise.operators import ranking as R

    items = [(i,) for i in range(30)]
    train, held = [(u, i) for u in (1, 2) for i in range(u, 30, 4)], [(u, i) for u in (1, 2) for i in range(u + 1, 30, 5) if (i - u) % 4]
    frame = lambda rows: spark.createDataFrame(rows, "user long, id long")
    got = {tuple(r) for r in R.shuffled_hits(spark.createDataFrame(items, "id long"), frame(train), frame(held), (F.col("id") * 7) % 31, F.col("user") * 11, 20).collect()}
    want = set()
    circle = sorted(range(30), key=lambda i: ((i * 7) % 31, i))
    for u in (1, 2):
        mine = [i for i in sorted(range(30), key=lambda i: (circle.index(i) - u * 11) % 30) if (u, i) not in set(train)]
        want |= {(u, i, mine.index(i)) for v, i in held if v == u and mine.index(i) < 20}
    assert got == want

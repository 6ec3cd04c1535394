"""Recommendation queries: content weights, baselines, factors, and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.numeric import settled
from platewise.operators import content, factors, hits, ranking
from platewise.plans import common as C
from platewise.plans.cleaning import doc_tokens
from platewise.plans.cleaning import SQL as CLEANING_SQL
from platewise.runtime import cut, free, let_go
from platewise.sources.tables import table


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    return content.tfidf(cut(doc_tokens(spark, folder)), table(spark, folder, "corpus", "id").count())


def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(spark, folder).select("id", "token", settled(F.col("w"), 6).alias("w"))


def heaviest_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The eight heaviest terms of each item."""
    return content.top_k(tfidf(spark, folder), "id", [F.desc("w"), F.col("token")], 8).select("id", "rn", "token", "w")


def _kept_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The weights, written once, without the counts that they are made of."""
    tokens = cut(doc_tokens(spark, folder))
    weights = cut(content.tfidf(tokens, table(spark, folder, "corpus", "id").count()))
    free(tokens)
    return weights


def _vectors(spark: SparkSession, folder: str, weights: DataFrame) -> DataFrame:
    """Vectors of the stated query set, users whose id is divisible by 100."""
    return content.user_vectors(weights, C.ratings(spark, folder).where("user % 100 = 0"))


def user_vector(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the query set of :func:`cosine_topk`; :func:`user_vector_all` has those of all users."""
    return _vectors(spark, folder, cut(_weights(spark, folder))).select("user", "token", settled(F.col("w"), 6).alias("w"))


def _all_vectors(spark: SparkSession, folder: str, weights: DataFrame) -> DataFrame:
    return content.user_vectors(weights, C.ratings(spark, folder))


def user_vector_all(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all users."""
    return _all_vectors(spark, folder, cut(_weights(spark, folder))).select("user", "token", settled(F.col("w"), 6).alias("w"))


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Ten best unseen items by cosine for each user of the query set."""
    weights = _kept_weights(spark, folder)
    seen = C.ratings(spark, folder).where("user % 100 = 0").select("user", "id")
    return content.cosine_top(weights, _vectors(spark, folder, weights), seen, 10)


def popularity(spark: SparkSession, folder: str) -> DataFrame:
    return C.ratings(spark, folder).groupBy("id").agg(F.count("*").alias("n"))


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = C.ratings(spark, folder)
    held = (F.col("user") * 31 + F.col("id") * 17) % 10 == 0
    return rows.where(~held), rows.where(held)


def mean_baselines_rmse(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _split(spark, folder)
    rows = factors.means(train, test)
    return rows.agg(F.count("*").alias("n"), *(settled(factors.rmse(F.col("rating"), F.col(c))).alias(c.replace("mean", "rmse")) for c in ("global_mean", "user_mean", "item_mean")))


def predicted_rating(spark: SparkSession, folder: str) -> DataFrame:
    """Error of damped biases per rating given."""
    train, test = _split(spark, folder)
    rows = factors.predict(test, *factors.biases(train))
    return rows.groupBy("rating").agg(F.count("*").alias("n"), settled(factors.rmse(F.col("rating"), F.col("predicted")), 3).alias("rmse"))


def mf_train(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the factor model against the means, on training and validation ratings."""
    train, test = _split(spark, folder)
    model = factors.factorise(train)
    mu, item, user, q, p = model
    out = []
    for name, rows in (("train", train), ("validation", test)):
        fitted = factors.predict(rows, mu, item, user, q, p).agg(factors.rmse(F.col("rating"), F.col("predicted")).alias("model_rmse"))
        plain = factors.means(train, rows).agg(factors.rmse(F.col("rating"), F.col("global_mean")).alias("global_rmse"))
        out.append(fitted.join(plain).select(F.lit(name).alias("part"), "model_rmse", "global_rmse"))
    return out[0].unionByName(out[1])


def _item_factors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("q"))


def latent_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Ten items of greatest factor product for the stated query vectors."""
    items = _item_factors(spark, folder)
    return factors.rank_items(items.where("id % 100 = 0").select(F.col("id").alias("user"), F.col("q").alias("p")), items, 10)


def fold_in(spark: SparkSession, folder: str) -> DataFrame:
    """Factors of customers from their rated parts, with whole vectors standing in for item factors."""
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    li = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    rated = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("id")).agg(F.max(F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("rating"))
    items = _item_factors(spark, folder)
    bias = items.select("id", F.lit(0.0).alias("bi"))
    return factors.fold_in(rated, bias, items, 3.0).select("user", settled(F.col("bu"), 6).alias("bu"), F.transform("p", lambda x: settled(x, 6)).alias("p"))


def known_item_count(spark: SparkSession, folder: str) -> DataFrame:
    """Rated items of each user that the corpus holds."""
    return C.ratings(spark, folder).join(table(spark, folder, "corpus", "id"), "id", "left_semi").groupBy("user").agg(F.count("*").alias("n"))


def switch_route(spark: SparkSession, folder: str) -> DataFrame:
    """Users by the recommender they get: factors from ten known ratings on, else content."""
    history = C.ratings(spark, folder).groupBy("user").agg(F.count("*").alias("history"))
    rows = history.join(known_item_count(spark, folder), "user", "left")
    route = F.when((F.col("history") >= 10) & (F.coalesce("n", F.lit(0)) >= 10), "factors").when(F.col("history") >= 10, "content: too few known items").otherwise("content: short history")
    return rows.groupBy(route.alias("route")).agg(F.count("*").alias("users"))


def eligible_users(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.eligible_users(C.ratings(spark, folder)).select("user", "n", "positives")


def _held(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = cut(C.ratings(spark, folder))
    users = ranking.eligible_users(rows)
    held = cut(ranking.holdout(rows, users, (F.col("user") * 31 + F.col("id") * 7919) % 10007))
    return rows.join(held, ["user", "id"], "left_anti"), held, users


def holdout_split(spark: SparkSession, folder: str) -> DataFrame:
    return _held(spark, folder)[1]


def prf_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and NDCG of the popularity list."""
    train, held, _ = _held(spark, folder)
    m = ranking.metrics(ranking.popularity_hits(train, held), held)
    return m.select("k", "users", *(settled(F.col(c), 6).alias(c) for c in ("precision", "recall", "ndcg")))


def by_population(spark: SparkSession, folder: str) -> DataFrame:
    """The same by length of the training history."""
    train, held, _ = _held(spark, folder)
    m = ranking.metrics(ranking.popularity_hits(train, held), held, _populations(train, held))
    return m.select("population", "k", "users", *(settled(F.col(c), 6).alias(c) for c in ("precision", "recall", "ndcg")))


def _populations(train: DataFrame, held: DataFrame) -> DataFrame:
    n = train.groupBy("user").agg(F.count("*").alias("n"))
    return held.select("user").distinct().join(n, "user", "left").select("user", F.when(F.col("n") >= 10, "warm").otherwise("cold").alias("population"))


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corpus", "id")


def _random_hits(spark: SparkSession, folder: str, train: DataFrame, held: DataFrame) -> DataFrame:
    return ranking.shuffled_hits(_catalogue(spark, folder), train, held, (F.col("id") * 7919) % 10007, F.col("user") * 104729)


def _content_lists(spark: SparkSession, folder: str, train: DataFrame, users: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best items of each of ``users`` by content, from the ratings kept for training."""
    weights = cut(_weights(spark, folder))
    mine = train.join(users, "user", "left_semi")
    return content.cosine_top(weights, content.user_vectors(weights, mine), mine.select("user", "id"), k)


def _factor_lists(spark: SparkSession, folder: str, train: DataFrame, users: DataFrame, k: int = 20, predicted: bool = False) -> DataFrame:
    """The same by the product of trained factors, or by the predicted rating, whose item bias then counts too."""
    _, item, _, q, p = factors.factorise(train)
    items = cut(q.join(item, "id").join(_catalogue(spark, folder), "id", "left_semi"))
    asked = p.join(users, "user", "left_semi").withColumn("one", F.lit(1.0))
    terms = factors.as_terms(items, "id", "q", "bi" if predicted else None), factors.as_terms(asked, "user", "p", "one" if predicted else None)
    return content.cosine_top(cut(terms[0]), terms[1], train.join(users, "user", "left_semi").select("user", "id"), k)


def _content_hits(spark: SparkSession, folder: str, train: DataFrame, held: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
    """``(user, id, rank0)`` of held-out items in the ``k`` best by content; lists are made only if the catalogue is too large for a task."""
    tokens = cut(doc_tokens(spark, folder))
    items = hits.coded(tokens, table(spark, folder, "corpus", "id").count())
    free(tokens)
    if items is None:
        return ranking.list_hits(_content_lists(spark, folder, train, held.select("user").distinct(), k), held)
    return hits.by_content(items, asked, k)


def _factor_hits(spark: SparkSession, folder: str, train: DataFrame, held: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
    """The same by the product of trained factors."""
    q, p = factors.factorise(train)[3:]
    # trained in single precision, and only those that are asked for
    q = cut(q.join(_catalogue(spark, folder), "id", "left_semi").withColumn("q", F.col("q").cast("array<float>")))
    p = cut(p.join(asked, "user", "left_semi").withColumn("p", F.col("p").cast("array<float>")))
    let_go(spark)  # the messages of the training's last iteration
    q, p = q.withColumn("q", F.col("q").cast("array<double>")), p.withColumn("p", F.col("p").cast("array<double>"))
    items = hits.factored(q)
    if items is None:
        return ranking.list_hits(_factor_lists(spark, folder, train, held.select("user").distinct(), k), held)
    return hits.by_factors(items, asked.join(p, "user"), k)


def _routes(spark: SparkSession, folder: str, train: DataFrame, users: DataFrame) -> DataFrame:
    """``(user, route)``: factors from ten ratings of known items on, else content."""
    known = train.join(_catalogue(spark, folder), "id", "left_semi").groupBy("user").agg(F.count("*").alias("n"))
    return users.join(known, "user", "left").select("user", F.when(F.col("n") >= 10, "factors").otherwise("content").alias("route"))


def switched(route: DataFrame, by_content: DataFrame, by_factors: DataFrame) -> DataFrame:
    """Each user's list, or hits, from the recommender that the user is routed to."""
    found = [lists.join(route.where(F.col("route") == name), "user", "left_semi") for name, lists in (("content", by_content), ("factors", by_factors))]
    return found[0].unionByName(found[1])


def _systems(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Hits of five systems, with the training and the held-out ratings."""
    train, held, _ = _held(spark, folder)
    train = cut(train)
    asked = cut(hits.asked(train, held))
    by_content, by_factors = _content_hits(spark, folder, train, held, asked), _factor_hits(spark, folder, train, held, asked)
    route = _routes(spark, folder, train, held.select("user").distinct())
    found = {"random": _random_hits(spark, folder, train, held), "popularity": ranking.popularity_hits(train, held)}
    return found | {"content": by_content, "factors": by_factors, "switching": switched(route, by_content, by_factors)}, train, held


def _reported(systems: dict[str, DataFrame], held: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    m = ranking.system_metrics(systems, held, groups)
    return m.select("system", "population", "k", "users", *(settled(F.col(c), 6).alias(c) for c in ("precision", "recall", "ndcg")))


def prf_random(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and NDCG of random lists."""
    train, held, _ = _held(spark, folder)
    return _reported({"random": _random_hits(spark, folder, train, held)}, held).drop("system", "population")


def prf_content(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and NDCG of the lists by content."""
    train, held, _ = _held(spark, folder)
    train = cut(train)
    found = _content_hits(spark, folder, train, held, cut(hits.asked(train, held)))
    return _reported({"content": found}, held).drop("system", "population")


def prf_systems(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and NDCG of random, popularity, content, factors and switching."""
    found, _, held = _systems(spark, folder)
    return _reported(found, held).drop("population")


def by_population_systems(spark: SparkSession, folder: str) -> DataFrame:
    """The same by length of the training history."""
    found, train, held = _systems(spark, folder)
    return _reported(found, held, cut(_populations(train, held)))


def ordering_support(spark: SparkSession, folder: str) -> DataFrame:
    """Median popularity of the ten best items of users with held-out ratings, ordered by predicted rating and by factors."""
    train, held, _ = _held(spark, folder)
    train, users = cut(train), held.select("user").distinct()
    counts = train.groupBy("id").agg(F.count("*").alias("n"))
    found = [_support(_factor_lists(spark, folder, train, users, 10, p), counts).select(F.lit(name).alias("ordering"), "*") for name, p in (("predicted rating", True), ("factors", False))]
    return found[0].unionByName(found[1])


def _support(best: DataFrame, counts: DataFrame) -> DataFrame:
    per_user = best.join(counts, "id", "left").groupBy("user").agg(F.median(F.coalesce("n", F.lit(0))).alias("m"))
    return per_user.agg(F.count("*").alias("users"), F.median("m").alias("median_support"))


def _best_unseen(spark: SparkSession, folder: str, rated: DataFrame) -> DataFrame:
    """The lists of :func:`cosine_topk` for the users of ``rated``, without stored weights or vectors if the catalogue fits a task."""
    tokens, n = cut(doc_tokens(spark, folder)), table(spark, folder, "corpus", "id").count()
    items = hits.coded(tokens, n)
    weights = cut(content.tfidf(tokens, n)) if items is None else None
    free(tokens)
    if weights is None:
        return hits.best_by_content(items, rated, 10)
    return content.cosine_top(weights, content.user_vectors(weights, rated), rated, 10)


def top10_support(spark: SparkSession, folder: str) -> DataFrame:
    """Median over the query set of :func:`cosine_topk` of the median popularity of the ten best items."""
    best = _best_unseen(spark, folder, cut(C.ratings(spark, folder).where("user % 100 = 0")))
    return _support(best, popularity(spark, folder))


def top10_support_all(spark: SparkSession, folder: str) -> DataFrame:
    """Median over all users with a vector of the median popularity of their ten best unseen items."""
    rated = cut(C.ratings(spark, folder))
    return _support(_best_unseen(spark, folder, rated), rated.groupBy("id").agg(F.count("*").alias("n")))


QUERIES = {
    f.__name__: f
    for f in (
        tfidf, heaviest_terms, user_vector, cosine_topk, popularity, mean_baselines_rmse, predicted_rating, mf_train, latent_rank, fold_in, known_item_count,
        user_vector_all, prf_random, prf_content, prf_systems, by_population_systems, ordering_support, switch_route, eligible_users, holdout_split, prf_ndcg, by_population, top10_support, top10_support_all,
    )
}

S = C.settled_sql
_TOKENS = CLEANING_SQL["doc_tokens"].replace("WITH ", "", 1).rsplit("SELECT id, token, count(*)", 1)
_WEIGHTS = "WITH " + _TOKENS[0] + """, tokens AS (SELECT id, token, count(*) AS tf FROM both_ GROUP BY 1, 2),
dfs AS (SELECT token, count(*) AS df FROM tokens GROUP BY 1 HAVING count(*) >= 2),
raws AS (SELECT id, token, (ln(tf::DOUBLE) + 1e0) * (ln((1e0 + (SELECT count(*) FROM corpus)) / (1e0 + df)) + 1e0) AS raw FROM tokens JOIN dfs USING (token)),
weights AS (SELECT id, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM raws)
"""
_VECTORS = _WEIGHTS + ", " + C.RATINGS_SQL + """, centred AS (SELECT "user", id, (rating - 3)::DOUBLE AS c FROM ratings WHERE rating <> 3 AND "user" % 100 = 0),
totals AS (SELECT "user", sum(abs(c)) AS total FROM centred GROUP BY 1),
sums AS (SELECT "user", token, sum(c * w) / any_value(total) AS w FROM centred JOIN weights USING (id) JOIN totals USING ("user") GROUP BY 1, 2),
norms AS (SELECT "user", sqrt(sum(w * w)) AS norm FROM sums GROUP BY 1),
vectors AS (SELECT "user", token, w / norm AS w FROM sums JOIN norms USING ("user") WHERE norm > 0)
"""
_COSINE = _VECTORS + f""", cos_ AS (SELECT v."user", t.id, {S("sum(t.w * v.w)", 6)} AS score FROM weights t JOIN vectors v USING (token) GROUP BY 1, 2),
best AS (SELECT "user", id, score, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, id)::INTEGER AS rn FROM cos_ c
    WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r."user" = c."user" AND r.id = c.id) QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY score DESC, id) <= 10)
"""
_SPLIT = "WITH " + C.RATINGS_SQL + """, train AS (SELECT * FROM ratings WHERE ("user" * 31 + id * 17) % 10 <> 0), test AS (SELECT * FROM ratings WHERE ("user" * 31 + id * 17) % 10 = 0)"""
_ELIGIBLE = """eligible AS (SELECT "user", count(*) AS n, count(*) FILTER (rating >= 4) AS positives FROM ratings GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (rating >= 4) >= 5)"""
_HELD = "WITH " + C.RATINGS_SQL + ", " + _ELIGIBLE + """, held AS (SELECT "user", id FROM ratings JOIN eligible USING ("user") WHERE rating >= 4
    QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ("user" * 31 + id * 7919) % 10007, id) <= greatest(2, round_even(positives * 0.2e0, 0)))"""
_TRAIN = _HELD + """, train AS (SELECT * FROM ratings r WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h."user" = r."user" AND h.id = r.id))"""
_PER = """,
hits AS (SELECT h."user", h.id, rank0 FROM held h JOIN lists l ON l."user" = h."user" AND l.id = h.id WHERE rank0 < 20),
rel AS (SELECT "user", count(*) AS n, CASE WHEN (SELECT count(*) FROM train t WHERE t."user" = held."user") >= 10 THEN 'warm' ELSE 'cold' END AS population FROM held GROUP BY "user"),
per AS (SELECT rel."user", population, n, k, (SELECT count(*) FROM hits h WHERE h."user" = rel."user" AND rank0 < k) AS h,
    coalesce((SELECT sum(1e0 / log2(rank0 + 2e0)) FROM hits h WHERE h."user" = rel."user" AND rank0 < k), 0e0) AS d,
    (SELECT sum(1e0 / log2(i + 1e0)) FROM range(1, least(n, k) + 1) x(i)) AS ideal FROM rel, (VALUES (5), (10), (20)) v(k))
"""
_HITS = _TRAIN + """,
pop AS (SELECT id, row_number() OVER (ORDER BY count(*) DESC, id) AS r FROM train GROUP BY id),
lists AS (SELECT u."user", pop.id, row_number() OVER (PARTITION BY u."user" ORDER BY r) - 1 AS rank0 FROM (SELECT DISTINCT "user" FROM held) u, pop
    WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."user" = u."user" AND t.id = pop.id))""" + _PER
_RANDOM = _TRAIN + """,
places AS (SELECT id, row_number() OVER (ORDER BY (id * 7919) % 10007, id) - 1 AS place, count(*) OVER () AS n FROM corpus),
lists AS (SELECT u."user", p.id, row_number() OVER (PARTITION BY u."user" ORDER BY (((place - u."user" * 104729) % n) + n) % n) - 1 AS rank0 FROM (SELECT DISTINCT "user" FROM held) u, places p
    WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."user" = u."user" AND t.id = p.id))""" + _PER
_CONTENT = _TRAIN + ", " + _WEIGHTS.replace("WITH ", "", 1) + """, centred AS (SELECT "user", id, (rating - 3)::DOUBLE AS c FROM train WHERE rating <> 3 AND "user" IN (SELECT "user" FROM held)),
totals AS (SELECT "user", sum(abs(c)) AS total FROM centred GROUP BY 1),
sums AS (SELECT "user", token, sum(c * w) / any_value(total) AS w FROM centred JOIN weights USING (id) JOIN totals USING ("user") GROUP BY 1, 2),
norms AS (SELECT "user", sqrt(sum(w * w)) AS norm FROM sums GROUP BY 1),
vectors AS (SELECT "user", token, w / norm AS w FROM sums JOIN norms USING ("user") WHERE norm > 0),
""" + f"""cos_ AS (SELECT v."user", t.id, {S("sum(t.w * v.w)", 6)} AS score FROM weights t JOIN vectors v USING (token) GROUP BY 1, 2),
lists AS (SELECT "user", id, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, id) - 1 AS rank0 FROM cos_ c WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."user" = c."user" AND t.id = c.id))""" + _PER
_MEANS = ", ".join(f"{S(e, 6)} AS {n}" for n, e in (("precision", "avg(h / k::DOUBLE)"), ("recall", "avg(h / n::DOUBLE)"), ("ndcg", "avg(d / ideal)")))
SQL = {
    "tfidf": _WEIGHTS + f"SELECT id, token, {S('w', 6)} AS w FROM weights",
    "heaviest_terms": _WEIGHTS + f", s AS (SELECT id, token, {S('w', 6)} AS w FROM weights) SELECT id, row_number() OVER (PARTITION BY id ORDER BY w DESC, token)::INTEGER AS rn, token, w FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, token) <= 8",
    "user_vector": _VECTORS + f'SELECT "user", token, {S("w", 6)} AS w FROM vectors',
    "cosine_topk": _COSINE + 'SELECT "user", rn, id, score FROM best',
    "popularity": "WITH " + C.RATINGS_SQL + "SELECT id, count(*) AS n FROM ratings GROUP BY 1",
    "mean_baselines_rmse": _SPLIT + """, g AS (SELECT avg(rating) AS m FROM train), u AS (SELECT "user", avg(rating) AS m FROM train GROUP BY 1), i AS (SELECT id, avg(rating) AS m FROM train GROUP BY 1),
        j AS (SELECT rating, g.m AS gm, coalesce(u.m, g.m) AS um, coalesce(i.m, g.m) AS im FROM test LEFT JOIN u USING ("user") LEFT JOIN i USING (id), g)
        SELECT count(*) AS n, """ + ", ".join(f"{S(f'sqrt(avg(pow(rating - least(greatest({c}, 1e0), 5e0), 2e0)))')} AS {n}" for n, c in (("global_rmse", "gm"), ("user_rmse", "um"), ("item_rmse", "im"))) + " FROM j",
    "predicted_rating": _SPLIT + """, g AS (SELECT avg(rating) AS mu FROM train), i AS (SELECT id, sum(rating - mu) / (count(*) + 5e0) AS bi FROM train, g GROUP BY 1),
        u AS (SELECT "user", sum(rating - mu - bi) / (count(*) + 5e0) AS bu FROM train JOIN i USING (id), g GROUP BY 1),
        j AS (SELECT rating, mu + coalesce(bi, 0) + coalesce(bu, 0) AS p FROM test LEFT JOIN i USING (id) LEFT JOIN u USING ("user"), g)
        SELECT rating, count(*) AS n, """ + S("sqrt(avg(pow(rating - least(greatest(p, 1e0), 5e0), 2e0)))", 3) + " AS rmse FROM j GROUP BY 1",
    "latent_rank": f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.id AS "user", b.id, {S("list_dot_product(a.v, b.v)", 6)} AS score FROM e a, e b WHERE a.id % 100 = 0)
        SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY score DESC, id)::INTEGER AS rn, id, score FROM s QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY score DESC, id) <= 10""",
    "known_item_count": "WITH " + C.RATINGS_SQL + 'SELECT "user", count(*) AS n FROM ratings WHERE id IN (SELECT id FROM corpus) GROUP BY 1',
    "switch_route": "WITH " + C.RATINGS_SQL + """, h AS (SELECT "user", count(*) AS a, count(*) FILTER (id IN (SELECT id FROM corpus)) AS b FROM ratings GROUP BY 1)
        SELECT CASE WHEN a >= 10 AND b >= 10 THEN 'factors' WHEN a >= 10 THEN 'content: too few known items' ELSE 'content: short history' END AS route, count(*) AS users FROM h GROUP BY 1""",
    "eligible_users": "WITH " + C.RATINGS_SQL + ", " + _ELIGIBLE + "SELECT * FROM eligible",
    "holdout_split": _HELD + "SELECT * FROM held",
    "prf_ndcg": _HITS + f"SELECT k, count(*) AS users, {_MEANS} FROM per GROUP BY 1",
    "prf_random": _RANDOM + f"SELECT k, count(*) AS users, {_MEANS} FROM per GROUP BY 1",
    "prf_content": _CONTENT + f"SELECT k, count(*) AS users, {_MEANS} FROM per GROUP BY 1",
    "by_population": _HITS + f"SELECT population, k, count(*) AS users, {_MEANS} FROM per GROUP BY 1, 2",
    "top10_support": _COSINE + """, pop AS (SELECT id, count(*) AS n FROM ratings GROUP BY 1), m AS (SELECT "user", median(coalesce(n, 0)::DOUBLE) AS m FROM best LEFT JOIN pop USING (id) GROUP BY 1)
        SELECT count(*) AS users, median(m) AS median_support FROM m""",
}

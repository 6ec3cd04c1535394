"""Rating models: means, damped biases, matrix factorisation, fold-in, and ranking by factors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.numeric import clamp, dot
from platewise.operators import als
from platewise.operators.content import top_k


def means(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with ``global_mean``, and the user's and item's mean of ``train`` or else the global one."""
    overall = train.agg(F.avg("rating").alias("global_mean"))
    user = train.groupBy("user").agg(F.avg("rating").alias("user_mean"))
    item = train.groupBy("id").agg(F.avg("rating").alias("item_mean"))
    out = test.join(user, "user", "left").join(item, "id", "left").join(F.broadcast(overall))  # one row
    return out.withColumns({c: F.coalesce(c, "global_mean") for c in ("user_mean", "item_mean")})


def rmse(actual, predicted):
    """Root mean square error of a prediction clipped to the rating scale."""
    return F.sqrt(F.avg(F.pow(actual - clamp(predicted, 1.0, 5.0), F.lit(2.0))))


def biases(train: DataFrame, damping: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Global mean, item biases and user biases of what the items leave, shrunk by ``damping``."""
    mu = train.agg(F.avg("rating").alias("mu"))
    centred = train.join(F.broadcast(mu)).withColumn("d", F.col("rating") - F.col("mu"))
    item = centred.groupBy("id").agg((F.sum("d") / (F.count("*") + damping)).alias("bi"))
    user = centred.join(item, "id").groupBy("user").agg((F.sum(F.col("d") - F.col("bi")) / (F.count("*") + damping)).alias("bu"))
    return mu, item, user


def predict(pairs: DataFrame, mu: DataFrame, item: DataFrame, user: DataFrame, item_factors: DataFrame | None = None, user_factors: DataFrame | None = None) -> DataFrame:
    """``pairs`` with ``predicted``: mean, biases and, where both are known, the factors' product.

    Unknown users, items and factors contribute nothing.  This is a rating; ranking
    uses :func:`rank_items`, since an item's bias swamps what the user's factors say.
    """
    out = pairs.join(item, "id", "left").join(user, "user", "left").join(F.broadcast(mu))
    value = F.col("mu") + F.coalesce("bi", F.lit(0.0)) + F.coalesce("bu", F.lit(0.0))
    if item_factors is not None and user_factors is not None:
        out = out.join(item_factors, "id", "left").join(user_factors, "user", "left")
        value = value + F.coalesce(dot(F.col("q"), F.col("p")), F.lit(0.0))
    return out.withColumn("predicted", value).drop("mu", "bi", "bu", "q", "p")


def factorise(train: DataFrame, rank: int = 20, iterations: int = 10, regularisation: float = 0.1, damping: float = 5.0, seed: int = 17, most: int = 40_000_000):
    """Biases, and alternating least squares on what they leave: ``(mu, item, user, item_factors, user_factors)``.

    :func:`als.train` solves where the vectors of one side, ``most`` values, fit a task, else
    Spark's solver, which starts from other vectors.  That one demands ids of 32 bits; larger
    ones are refused by the cast.  Its every iteration is checkpointed, where the session has a
    folder for it, and its messages deleted: else the messages of ten iterations lie on the disk.
    """
    from pyspark.ml.recommendation import ALS

    mu, item, user = biases(train, damping)
    found = als.train(train, rank, iterations, regularisation, damping, seed, most)
    if found is not None:
        return mu, item, user, *found
    rest = predict(train, mu, item, user).select(F.col("user").cast("int").alias("u"), F.col("id").cast("int").alias("i"), (F.col("rating") - F.col("predicted")).cast("float").alias("r"))
    model = ALS(rank=rank, maxIter=iterations, regParam=regularisation, userCol="u", itemCol="i", ratingCol="r", nonnegative=False, checkpointInterval=1, seed=seed, coldStartStrategy="nan").fit(rest)
    as_doubles = F.col("features").cast("array<double>")
    return mu, item, user, model.itemFactors.select(F.col("id").cast("long").alias("id"), as_doubles.alias("q")), model.userFactors.select(F.col("id").cast("long").alias("user"), as_doubles.alias("p"))


def fold_in(ratings: DataFrame, item: DataFrame, item_factors: DataFrame, mu: float, ridge: float = 0.1) -> DataFrame:
    """``(user, bu, p array<double>)`` of users from their ratings of known items.

    Solves ``(Q'Q + ridge I) p = Q'(r - mu - bi)`` per user; ``bu`` is the mean of
    ``r - mu - bi``.  Each task sends a user's few rows as they are and reduces more
    rows than a vector has values to as many by QR, which keeps ``Q'Q`` and ``Q'y``:
    a user with a third of all ratings costs no task more than its own share.
    """
    known = ratings.join(item_factors, "id").join(item, "id", "left").select("user", "q", (F.col("rating") - F.lit(float(mu)) - F.coalesce("bi", F.lit(0.0))).alias("y"))

    def reduced(frames):
        out = []
        for user, part in pd.concat(frames).groupby("user", sort=False):
            q, y = np.stack(part["q"].to_numpy()).astype(float), part["y"].to_numpy(float)
            n, s = len(y), y.sum()
            if n > q.shape[1]:
                basis, q = np.linalg.qr(q)
                y = basis.T @ y
            out.append((user, n, s, q.ravel(), y))
        return pd.DataFrame(out, columns=["user", "n", "s", "q", "y"])

    def partial(batches):
        held, cells = [], 0
        for frame in batches:
            if len(frame):
                held.append(frame)
                cells += len(frame) * len(frame["q"].iloc[0])
            if cells > 2_000_000:  # bounds the task's memory; the parts are put together after the shuffle
                yield reduced(held)
                held, cells = [], 0
        if held:
            yield reduced(held)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        y = np.concatenate(part["y"].to_numpy())
        q = np.concatenate(part["q"].to_numpy()).reshape(len(y), -1)
        p = np.linalg.solve(q.T @ q + ridge * np.eye(q.shape[1]), q.T @ y)
        return pd.DataFrame({"user": [part["user"].iloc[0]], "bu": [part["s"].sum() / part["n"].sum()], "p": [p.tolist()]})

    sums = known.mapInPandas(partial, "user long, n long, s double, q array<double>, y array<double>")
    return sums.groupBy("user").applyInPandas(solve, "user long, bu double, p array<double>")


def rank_items(queries: DataFrame, items: DataFrame, k: int, broadcast_rows: int = 20_000) -> DataFrame:
    """``(user, rn, id, score)``: the ``k`` items of greatest product with each query's factors, ties by id.

    ``queries`` is ``(user, p)``, a stated set; it is sent to every task only if its
    counted size allows, else every block of items meets its own copy of the set.
    """
    if queries.limit(broadcast_rows + 1).count() <= broadcast_rows:
        pairs = items.join(F.broadcast(queries), F.size("q") == F.size("p"))
    else:
        blocks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        copies = queries.select("user", "p", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        pairs = items.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).join(copies, "block").where(F.size("q") == F.size("p"))
    scored = pairs.select("user", "id", (F.floor(dot(F.col("q"), F.col("p")) * 1e6 + 0.5) / 1e6).alias("score"))
    return top_k(scored, "user", [F.desc("score"), F.col("id")], k).select("user", "rn", "id", "score")


def as_terms(vectors: DataFrame, key: str, values: str, extra: str | None = None) -> DataFrame:
    """``(key, token, w)``: the values of dense vectors by place, with column ``extra`` as one more."""
    terms = vectors.select(key, F.posexplode(values).alias("place", "w")).select(key, F.col("place").cast("string").alias("token"), "w")
    return terms if extra is None else terms.unionByName(vectors.select(key, F.lit("+").alias("token"), F.col(extra).cast("double").alias("w")))

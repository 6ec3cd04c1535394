"""Content similarity: TF-IDF weights, user vectors and cosine scores as long tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.runtime import cut


def repeated_terms(tokens: DataFrame, key: str = "id", term: str = "token", least: int = 2) -> DataFrame:
    """``(term, df)`` of terms that at least ``least`` documents hold."""
    return tokens.groupBy(term).agg(F.count_distinct(key).alias("df")).where(F.col("df") >= least)


def tfidf(counts: DataFrame, n_docs: int, key: str = "id", term: str = "token", tf: str = "tf", least: int = 2) -> DataFrame:
    """``(key, term, w)``: (1 + ln tf) (ln((1 + N) / (1 + df)) + 1), rows of unit length.

    ``counts`` has one row per document and term.  Terms in fewer than ``least``
    documents are dropped.  The join on a frequent term is skewed on the counts'
    side only, which adaptive execution splits.
    """
    df = counts.groupBy(term).agg(F.count("*").alias("df")).where(F.col("df") >= least)
    idf = F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    raw = counts.join(df, term).select(key, term, ((F.ln(F.col(tf).cast("double")) + 1.0) * idf).alias("raw"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, key).select(key, term, (F.col("raw") / F.col("norm")).alias("w"))


def user_vectors(weights: DataFrame, ratings: DataFrame, liked: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """``(user, token, w)`` of unit length.

    Sum of the idf of liked terms, plus the rated rows weighted by rating minus 3
    over the sum of those weights' sizes, minus half the mean of the rejected rows.
    ``ratings`` is ``(user, id, rating)``, ``liked`` ``(user, token, idf)``,
    ``rejected`` ``(user, id)``.  Users without any evidence have no rows.
    """
    centred = ratings.select("user", "id", (F.col("rating") - 3).cast("double").alias("c")).where("c <> 0")
    total = centred.groupBy("user").agg(F.sum(F.abs("c")).alias("total"))
    rows = centred.join(weights, "id").select("user", "token", (F.col("c") * F.col("w")).alias("w"))
    # the long rows move once: sums, totals and norms then all find them by user
    parts = rows.repartition("user").groupBy("user", "token").agg(F.sum("w").alias("w")).join(total, "user").select("user", "token", (F.col("w") / F.col("total")).alias("w"))
    if liked is not None:
        parts = parts.unionByName(liked.select("user", "token", F.col("idf").alias("w")))
    if rejected is not None:
        n = rejected.groupBy("user").agg(F.count("*").alias("n"))
        away = rejected.join(weights, "id").groupBy("user", "token").agg(F.sum("w").alias("w")).join(n, "user")
        parts = parts.unionByName(away.select("user", "token", (F.col("w") / F.col("n") * -0.5).alias("w")))
    summed = parts if liked is None and rejected is None else parts.groupBy("user", "token").agg(F.sum("w").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("user")))
    return summed.withColumn("norm", norm).where("norm > 0").select("user", "token", (F.col("w") / F.col("norm")).alias("w"))


def cosine(weights: DataFrame, vectors: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """``(user, id, score)`` of every pair that shares a term: a sparse product as an equality join.

    If the vectors' counted rows allow, they go to every task: the documents are then
    spread by id and each sums its own products, so the products never move and a term
    that a third of the documents hold is shared out.  Else both sides meet by term.
    """
    v = vectors.select("user", "token", F.col("w").alias("u"))
    if v.limit(broadcast_rows + 1).count() <= broadcast_rows:
        parts = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        joined = weights.repartition(parts, "id").join(F.broadcast(v), "token")
    else:
        joined = weights.join(v, "token")
    return joined.groupBy("user", "id").agg(F.sum(F.col("w") * F.col("u")).alias("score"))


def cosine_top(weights: DataFrame, vectors: DataFrame, seen: DataFrame, k: int, most_weights: int = 2_500_000, most_items: int = 125_000) -> DataFrame:
    """``(user, rn, id, score)``: each user's ``k`` best items of :func:`cosine` that are not in ``seen`` ``(user, id)``.

    For all users at once: no pair becomes a row.  The items go to every task in blocks
    whose counted weights and items are bounded, one block after the other.  A task holds
    the terms of most items as a dense matrix and adds the others by their postings.
    Scores are settled to six digits, ties go to the lower id; items that share no term
    with the user have no score, whatever the sign of the others.
    """
    spark = weights.sparkSession
    n, m = weights.agg(F.count("*"), F.count_distinct("id")).first()
    blocks = max(1, -(-n // most_weights), -(-m // most_items))
    packed = vectors.groupBy("user").agg(F.collect_list(F.struct("token", "w")).alias("v"))
    rated = seen.groupBy("user").agg(F.collect_list("id").alias("seen"))
    users = packed.join(rated, "user", "left").select("user", F.col("v.token").alias("token"), F.col("v.w").alias("w"), F.coalesce("seen", F.array().cast("array<bigint>")).alias("seen"))
    users = users if blocks == 1 else cut(users)
    out = []
    for block in range(blocks):
        sent = spark.sparkContext.broadcast(_postings(weights.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "token", "w").toArrow()))

        def run(batches, sent=sent):
            best = _Best(*sent.value, k)
            for batch in batches:
                for at in range(0, batch.num_rows, 32):
                    yield best.of(batch.slice(at, 32))

        out.append(cut(users.mapInArrow(run, "user long, rn int, id long, score double")))
        sent.destroy()
    if blocks == 1:
        return out[0]
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return top_k(rows.drop("rn"), "user", [F.desc("score"), F.col("id")], k).select("user", "rn", "id", "score")


def _postings(weights: pa.Table) -> tuple:
    """Item ids in order, the terms, where each term's postings start, and the postings' items and weights."""
    ids, item = np.unique(weights.column("id").to_numpy(), return_inverse=True)
    coded = weights.column("token").combine_chunks().dictionary_encode()
    term = coded.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    return ids, coded.dictionary, np.searchsorted(term[order], np.arange(len(coded.dictionary) + 1)), item[order], weights.column("w").to_numpy()[order]


class _Best:
    """The best items of users by one block of items."""

    def __init__(self, ids, terms, starts, item, weight, k: int, dense: int = 80, cells: int = 8_000_000) -> None:
        self.ids, self.terms, self.starts, self.item, self.weight, self.k = ids, terms, starts, item, weight, k
        heavy = np.argsort(-np.diff(starts), kind="stable")[: min(dense, cells // max(len(ids), 1))]
        self.place = np.full(len(terms) + 1, -1)  # the last is that of an unknown term
        self.place[heavy] = np.arange(len(heavy))
        self.rows = np.zeros((len(heavy), len(ids)))
        for i, t in enumerate(heavy):
            self.rows[i, item[starts[t] : starts[t + 1]]] = weight[starts[t] : starts[t + 1]]

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        users, n = batch.column(0), batch.num_rows
        term = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=self.terms), -1).to_numpy()
        w, seen = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        upto, seen_upto = (np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(c)).to_numpy())]) for c in (1, 3))
        owner = np.repeat(np.arange(n), np.diff(upto))
        heavy = self.place[term] >= 0
        left = np.zeros((n, len(self.rows)))
        left[owner[heavy], self.place[term[heavy]]] = w[heavy]
        scores = left @ self.rows
        lists = []
        for u in range(n):
            own = slice(upto[u], upto[u + 1])
            light = (term[own] >= 0) & ~heavy[own]
            for t, x in zip(term[own][light].tolist(), w[own][light].tolist(), strict=True):
                a, b = self.starts[t], self.starts[t + 1]
                scores[u, self.item[a:b]] += x * self.weight[a:b]
            lists.append(self._list(scores[u], term[own], seen[seen_upto[u] : seen_upto[u + 1]]))
        sizes = [len(i) for i, _ in lists]
        return pa.RecordBatch.from_arrays(
            [
                users.take(pa.array(np.repeat(np.arange(n), sizes))), pa.array(np.concatenate([np.arange(1, s + 1) for s in sizes]).astype(np.int32)),
                pa.array(np.concatenate([i for i, _ in lists]).astype(np.int64)), pa.array(np.concatenate([s for _, s in lists]).astype(float)),
            ],
            names=["user", "rn", "id", "score"],
        )

    def _list(self, score: np.ndarray, terms: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.ids, seen)
        at = at[at < len(self.ids)]
        score[at[np.isin(self.ids[at], seen)]] = -np.inf
        least = self._least(score)
        if least <= 1e-5:  # zeros may be among the best: tell those that share a term
            shares = np.zeros(len(score), bool)
            for t in terms[terms >= 0]:
                shares[self.item[self.starts[t] : self.starts[t + 1]]] = True
            score[~shares] = -np.inf
            least = self._least(score)
        found = np.flatnonzero(score >= least - 2e-6)
        found = found[np.isfinite(score[found])]
        settled = np.floor(score[found] * 1e6 + 0.5) / 1e6
        order = np.lexsort((self.ids[found], -settled))[: self.k]
        return self.ids[found[order]], settled[order]

    def _least(self, score: np.ndarray) -> float:
        """A value that at least ``k`` scores reach, if there are so many: the k-th of the maxima of a hundred each."""
        if len(score) >= 100 * self.k:
            score = score[: len(score) // 100 * 100].reshape(-1, 100).max(axis=1)
        return np.partition(score, -self.k)[-self.k] if len(score) >= self.k else -np.inf


def top_k(df: DataFrame, group: list[str] | str, order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group; the limit is applied before the shuffle."""
    groups = [group] if isinstance(group, str) else group
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= k)

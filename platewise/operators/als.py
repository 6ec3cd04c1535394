"""Alternating ridge solves of a factor model whose vectors of one side fit a task.

The ratings are packed twice, by user and by item: a row of either table holds all ratings of
a share of its keys, with places in the other side's list of keys in the place of ids.  An
iteration maps both tables once, against the other side's vectors, which are read from the
shared folder; no rating and no vector is shuffled after the packing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.runtime import cut, free

_PACKED = "part int, n long, keys binary, sizes binary, others binary, r binary, bias binary"
_CODED = "part int, keys binary, sizes binary, at binary, y binary, bias binary"
_FACTORS = "part int, keys binary, v binary"


def train(ratings: DataFrame, rank: int, iterations: int, regularisation: float, damping: float, seed: int, most: int) -> tuple[DataFrame, DataFrame] | None:
    """``(id, q)`` and ``(user, p)``, or ``None`` if a side has more than ``most`` values or tasks cannot read the shared folder.

    ``ratings`` is ``(user, id, rating)``.  What is factorised are the ratings less the mean and
    the damped biases of :func:`factors.biases`; the ridge of a key is ``regularisation`` times
    its ratings, and the users' first vectors have unit length and depend on their ids alone.
    """
    mu = ratings.agg(F.avg("rating")).first()[0]
    if mu is None:
        return None
    items = cut(_pack(ratings, "id", "user", mu, damping))
    users = cut(_pack(ratings, "user", "id", mu, damping))
    starts = [_starts(x) for x in (items, users)]
    if max(n for _, n in starts) * rank > most or not _readable(items):
        free(items, users)
        return None
    coded_users = cut(_code(users, items, *starts[0], mu, damping))
    coded_items = cut(_code(items, coded_users, *starts[1], mu, None))
    free(items, users)
    p = cut(_first(coded_users, rank, seed))
    q = None
    for _ in range(iterations):
        if q is not None:
            free(q)
        q = cut(_solved(coded_items, p, *starts[1], rank, regularisation))
        free(p)
        p = cut(_solved(coded_users, q, *starts[0], rank, regularisation))
    free(coded_items, coded_users)
    return _rows(q, rank, "id", "q"), _rows(p, rank, "user", "p")


def _starts(packed: DataFrame) -> tuple[dict[int, int], int]:
    """Where the keys of each part begin in the list of all keys, and their number; one row per task."""
    sizes = sorted((r["part"], r["n"]) for r in packed.select("part", "n").collect())
    ends = np.cumsum([n for _, n in sizes]).tolist()
    return {part: end - n for (part, n), end in zip(sizes, ends, strict=True)}, (ends[-1] if ends else 0)


def _readable(table: DataFrame) -> bool:
    try:
        return ds.dataset(table.table_path, format="parquet").count_rows() >= 0
    except (OSError, pa.ArrowException):
        return False


def _batch(schema: str, *values) -> pa.RecordBatch:
    """One row; arrays become their bytes."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    cells = [pa.array([x.tobytes() if isinstance(x, np.ndarray) else x], kinds[k.split()[1]]) for x, k in zip(values, schema.split(", "), strict=True)]
    return pa.RecordBatch.from_arrays(cells, names=names)


def _bytes(batch: pa.RecordBatch, name: str, row: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)


def _pack(ratings: DataFrame, key: str, other: str, mu: float, damping: float) -> DataFrame:
    """A row for each task: its keys in order, how many ratings each has, the other ids and ratings, and the keys' biases."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        keys, others, r = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        order = np.argsort(keys, kind="stable")
        keys, others, r = keys[order], others[order], r[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(begin, len(keys)))
        bias = np.add.reduceat(r - mu, begin) / (sizes + damping)
        yield _batch(_PACKED, TaskContext.get().partitionId(), len(begin), keys[begin], sizes.astype(np.int32), others, r.astype(np.float32), bias)

    parts = int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ratings.select(F.col(key).cast("long"), F.col(other).cast("long"), F.col("rating").cast("double"))
    return rows.repartition(parts, key).mapInArrow(run, _PACKED)


#: what this worker has read last: tasks of one stage read the same
_READ: dict[tuple, list[np.ndarray]] = {}


def _whole(path: str, starts: dict[int, int], n: int, columns: tuple, width: int = 1) -> list[np.ndarray]:
    """Columns ``(name, type)`` of all parts of a table, one after the other."""
    if (path, columns) not in _READ:
        _READ.clear()
        out = [np.empty((n, width) if width > 1 else n, kind) for _, kind in columns]
        for piece in ds.dataset(path, format="parquet").get_fragments():
            found = piece.to_table(columns=["part", *(name for name, _ in columns)], use_threads=False).combine_chunks()
            for batch in found.to_batches():
                for row in range(batch.num_rows):
                    a = starts[batch.column("part")[row].as_py()]
                    for into, (name, kind) in zip(out, columns, strict=True):
                        values = _bytes(batch, name, row, kind)
                        into[a : a + len(values) // width] = values.reshape(-1, width) if width > 1 else values
        _READ[path, columns] = out
    return _READ[path, columns]


def _code(packed: DataFrame, other: DataFrame, starts: dict[int, int], n: int, mu: float, damping: float | None) -> DataFrame:
    """The packed rows with the others' places, and ratings less mean and biases; with ``damping`` the keys' biases are of what the others leave."""
    path = other.table_path

    def run(batches):
        keys, bias = _whole(path, starts, n, (("keys", np.int64), ("bias", np.float64)))
        order = np.argsort(keys)
        ordered = keys[order]
        for batch in batches:
            for row in range(batch.num_rows):
                sizes = _bytes(batch, "sizes", row, np.int32)
                at = order[np.searchsorted(ordered, _bytes(batch, "others", row, np.int64))].astype(np.int32)
                y = _bytes(batch, "r", row, np.float32) - mu - bias[at]
                own = _bytes(batch, "bias", row, np.float64)
                if damping is not None:
                    own = np.add.reduceat(y, np.cumsum(sizes) - sizes) / (sizes + damping)
                y = (y - np.repeat(own, sizes)).astype(np.float32)
                yield _batch(_CODED, batch.column("part")[row].as_py(), _bytes(batch, "keys", row, np.int64), sizes, at, y, own)

    return packed.mapInArrow(run, _CODED)


def _first(coded: DataFrame, rank: int, seed: int) -> DataFrame:
    """Unit vectors by the keys and ``seed`` alone, however the keys are shared out."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                keys = _bytes(batch, "keys", row, np.int64)
                with np.errstate(over="ignore"):
                    x = (keys[:, None].astype(np.uint64) * np.uint64(rank) + np.arange(rank, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
                v = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 - 0.5
                v /= np.sqrt(np.square(v).sum(axis=1, keepdims=True)) + 1e-12
                yield _batch(_FACTORS, batch.column("part")[row].as_py(), keys, v.astype(np.float32))

    return coded.select("part", "keys").mapInArrow(run, _FACTORS)


def _solved(coded: DataFrame, factors: DataFrame, starts: dict[int, int], n: int, rank: int, regularisation: float) -> DataFrame:
    """The vectors of the coded keys, given those of the other side."""
    path = factors.table_path

    def run(batches):
        (other,) = _whole(path, starts, n, (("v", np.float32),), rank)
        other = other.reshape(-1, rank)
        for batch in batches:
            for row in range(batch.num_rows):
                v = ridge(_bytes(batch, "sizes", row, np.int32), _bytes(batch, "at", row, np.int32), _bytes(batch, "y", row, np.float32), other, regularisation)
                yield _batch(_FACTORS, batch.column("part")[row].as_py(), _bytes(batch, "keys", row, np.int64), v)

    return coded.select("part", "keys", "sizes", "at", "y").mapInArrow(run, _FACTORS)


def ridge(sizes: np.ndarray, at: np.ndarray, y: np.ndarray, q: np.ndarray, regularisation: float, cells: int = 500_000) -> np.ndarray:
    """The vectors ``v`` of least ``|X v - y|^2 + regularisation * len(y) * |v|^2`` of many keys.

    The rows of ``X`` are those of ``q`` at ``at``, ``sizes`` of them for one key after the other.
    Keys of as many rows are solved together: with at most as many rows as columns by the
    rows' products, else by the columns'.
    """
    rank = q.shape[1]
    out = np.zeros((len(sizes), rank), np.float32)
    begin, order = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1)).tolist() + [len(order)]
    keys, squares, sides = [np.zeros(0, np.int64)], [np.zeros((0, rank, rank))], [np.zeros((0, rank))]
    for a, b in zip(bounds, bounds[1:], strict=False):
        size = int(sizes[order[a]])
        step = max(1, cells // max(size * rank, 1))
        for c in range(a, b, step):
            own = order[c : min(b, c + step)]
            if size <= rank:
                where = begin[own][:, None] + np.arange(size)
                x = q[at[where]]
                g = np.matmul(x, x.transpose(0, 2, 1)).astype(float)
                g[:, np.arange(size), np.arange(size)] += regularisation * size
                out[own] = np.matmul(eliminate(g, y[where].astype(float))[:, None], x)[:, 0]
                continue
            square, side = np.zeros((len(own), rank, rank)), np.zeros((len(own), rank))
            most = max(1, cells // rank)
            for first in range(0, size, most):  # only a key with more rows than that takes more than one turn
                where = begin[own][:, None] + np.arange(first, min(size, first + most))
                x = q[at[where]]
                square += np.matmul(x.transpose(0, 2, 1), x)
                side += np.matmul(y[where][:, None], x)[:, 0]
            square[:, np.arange(rank), np.arange(rank)] += regularisation * size
            keys.append(own)
            squares.append(square)
            sides.append(side)
    out[np.concatenate(keys)] = eliminate(np.concatenate(squares), np.concatenate(sides))
    return out


def eliminate(g: np.ndarray, b: np.ndarray, cells: int = 50_000) -> np.ndarray:
    """The solutions of many positive definite systems of one size, a column of all at a time."""
    out, d = np.empty_like(b), b.shape[1]
    step = max(64, cells // max(d * d, 1))
    for first in range(0, len(b), step):
        a, x = np.ascontiguousarray(g[first : first + step].transpose(1, 2, 0)), np.ascontiguousarray(b[first : first + step].T)
        for j in range(d - 1):
            f = a[j + 1 :, j] / a[j, j]
            a[j + 1 :, j + 1 :] -= f[:, None] * a[j, j + 1 :]
            x[j + 1 :] -= f * x[j]
        for j in range(d - 1, -1, -1):
            x[j] = (x[j] - (a[j, j + 1 :] * x[j + 1 :]).sum(axis=0)) / a[j, j]
        out[first : first + step] = x.T
    return out


def _rows(factors: DataFrame, rank: int, key: str, name: str) -> DataFrame:
    """``(key, name array<double>)``, a row for each vector."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                keys, v = _bytes(batch, "keys", row, np.int64), _bytes(batch, "v", row, np.float32)
                for a in range(0, len(keys), 10_000):
                    b = min(len(keys), a + 10_000)
                    lists = pa.ListArray.from_arrays(np.arange(0, (b - a) * rank + 1, rank, dtype=np.int32), v[a * rank : b * rank].astype(float))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b]), lists], names=[key, name])

    return factors.mapInArrow(run, f"{key} long, {name} array<double>")

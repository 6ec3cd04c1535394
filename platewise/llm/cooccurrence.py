"""Items that appear together: pair counts and lift by heavy-light decomposition.

Every input partition is read once and turned into partial pair counts, which a
single shuffle then adds up:

* heavy x heavy: the block's records are laid out as one bit vector per heavy
  item; a pair's count is the popcount of the conjunction of two vectors;
* light x light: pairs inside a record are hashed to codes and counted in place;
* heavy x light: the postings of the light items probe the bit matrix.

An item is heavy if it holds at least ``1 / max_heavy`` of all postings, so there
are at most ``max_heavy`` of them whatever the data: that list alone is sent to
the tasks unconditionally.  The dictionary of items that can still reach the
support threshold is sent only if its size, which is checked, allows; otherwise a
join prunes the postings.  Neither way drops a pair that could qualify.

Defined results: an item counts once per record, null items are ignored, and a
record counts towards ``n`` if its array is neither null nor empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.runtime import at_most, cut

#: records per bit matrix; with 1024 heavy items a matrix is 8 MB
BLOCK = 1 << 16
#: light pair codes counted at once
CHUNK = 1 << 21


def supports(df: DataFrame, items: str) -> DataFrame:
    """``(item, n_item)``: records that hold each item."""
    return (
        df.select(F.explode(F.array_distinct(items)).alias("item"))
        .where("item is not null")
        .groupBy("item")
        .agg(F.count("*").alias("n_item"))
    )


class _Counter:
    """Partial pair counts of one partition, over codes of a block-local dictionary."""

    def __init__(self, heavy: list[str], keep: pa.Array | None):
        self.heavy = pa.array(heavy, pa.string())
        self.keep = keep

    def block(self, lists: pa.Array):
        """Count all pairs of a block of records; yields ``(names_a, names_b, counts)``."""
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lists), dtype=np.int64), lengths)
        values = pc.list_flatten(lists)
        coded = pc.dictionary_encode(values)
        codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary
        if not len(names):
            return
        usable = np.ones(len(names), bool)
        if self.keep is not None:
            usable = pc.is_in(names, value_set=self.keep).to_numpy(zero_copy_only=False)
        rank = pc.fill_null(pc.index_in(names, value_set=self.heavy), -1).to_numpy(zero_copy_only=False)
        good = codes >= 0
        good[good] = usable[codes[good]]
        rows, codes = rows[good], codes[good]
        flat = np.unique(rows * len(names) + codes)  # once per record, sorted by record
        rows, codes = flat // len(names), flat % len(names)
        is_heavy = rank[codes] >= 0
        yield from self._dense(rows[is_heavy], rank[codes[is_heavy]], len(lists))
        yield from self._sparse(rows[~is_heavy], codes[~is_heavy], names)
        yield from self._probe(rows[is_heavy], rank[codes[is_heavy]], rows[~is_heavy], codes[~is_heavy], names, len(lists))

    def _bits(self, rows: np.ndarray, ranks: np.ndarray, n: int) -> np.ndarray:
        """Bit matrix, one row of 64-bit words per heavy item."""
        cells = np.zeros((len(self.heavy), (n + 63) // 64 * 64), np.uint8)
        cells[ranks, rows] = 1
        return np.packbits(cells, axis=1, bitorder="little").view(np.uint64)

    def _dense(self, rows, ranks, n):
        present = np.unique(ranks)
        if len(present) < 2:
            return
        bits = self._bits(rows, ranks, n)[present]
        for i in range(len(present) - 1):
            counts = np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(counts)
            if len(hit):
                a = self.heavy.take(pa.array(np.full(len(hit), present[i])))
                yield a, self.heavy.take(pa.array(present[i + 1 + hit])), counts[hit]

    @staticmethod
    def _tally(codes: np.ndarray, width: int, left: pa.Array, right: pa.Array):
        pairs, counts = np.unique(codes, return_counts=True)
        yield left.take(pa.array(pairs // width)), right.take(pa.array(pairs % width)), counts

    def _sparse(self, rows, codes, names):
        """Pairs of light items inside a record, at distance 1, 2, ... in its sorted list."""
        held, size, width = [], 0, len(names)
        step, at = 1, np.arange(len(rows))
        while len(at):
            at = at[at + step < len(rows)]
            at = at[rows[at] == rows[at + step]]
            for part in (at[i : i + CHUNK] for i in range(0, len(at), CHUNK)):
                held.append(codes[part] * width + codes[part + step])
                size += len(part)
                if size >= CHUNK:
                    yield from self._tally(np.concatenate(held), width, names, names)
                    held, size = [], 0
            step += 1
        if held:
            yield from self._tally(np.concatenate(held), width, names, names)

    def _probe(self, rows_h, ranks, rows_l, codes, names, n):
        """Postings of light items look up their record's row of heavy bits."""
        if not len(rows_h) or not len(rows_l):
            return
        words = (len(self.heavy) + 7) // 8
        matrix = np.zeros((n, words * 8), np.uint8)
        matrix[rows_h, ranks] = 1
        matrix = np.packbits(matrix, axis=1, bitorder="little")
        width, step = len(self.heavy), max(1, CHUNK // (words * 8))
        held, size = [], 0
        for i in range(0, len(rows_l), step):
            probed = np.unpackbits(matrix[rows_l[i : i + step]], axis=1, bitorder="little")
            posting, rank = np.nonzero(probed)
            held.append(codes[i : i + step][posting] * width + rank)
            size += len(posting)
            if size >= CHUNK:
                yield from self._tally(np.concatenate(held), width, names, self.heavy)
                held, size = [], 0
        if size:
            yield from self._tally(np.concatenate(held), width, names, self.heavy)


def pair_counts(df: DataFrame, items: str, heavy: list[str], keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``(item_a, item_b, n_ab)`` for all pairs, ``item_a < item_b`` in byte order.

    ``keep`` restricts the items; ``heavy`` names those counted in the bit matrix.
    """
    schema = pa.schema([("item_a", pa.string()), ("item_b", pa.string()), ("n", pa.int64())])

    def run(batches):
        counter = _Counter(heavy, None if keep is None else pa.array(keep, pa.string()))

        def flush(parts):
            for a, b, n in counter.block(pa.concat_arrays(parts)):
                yield pa.RecordBatch.from_arrays([a.cast(pa.string()), b.cast(pa.string()), pa.array(n, pa.int64())], schema=schema)

        parts, size = [], 0
        for batch in batches:
            column = batch.column(0)
            for i in range(0, len(column), block):
                piece = column.slice(i, block)
                if size and size + len(piece) > block:
                    yield from flush(parts)
                    parts, size = [], 0
                parts.append(piece)
                size += len(piece)
        if parts:
            yield from flush(parts)

    partial = df.select(F.col(items).alias("__items")).mapInArrow(run, "item_a string, item_b string, n long")
    low = F.col("item_a") < F.col("item_b")
    return (
        partial.groupBy(
            F.when(low, F.col("item_a")).otherwise(F.col("item_b")).alias("item_a"),
            F.when(low, F.col("item_b")).otherwise(F.col("item_a")).alias("item_b"),
        ).agg(F.sum("n").alias("n_ab"))
    )


def frequent_pairs(
    df: DataFrame, items: str, min_count: int = 1, per_mille: int = 0, max_heavy: int = 512, dictionary: int = 200_000
) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n, lift)`` of pairs that enough records share.

    A pair needs ``n_ab >= min_count`` and ``1000 * n_ab >= per_mille * n``.  An
    item below those bounds cannot be in such a pair, so it is left out of the
    counting.  Only ``items`` is read.
    """
    records = df.select(F.col(items).alias("__items")).where("size(__items) > 0")
    total = records.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("__items")), F.lit(0)).alias("postings")).first()
    floor = max(min_count, -(-per_mille * total["n"] // 1000))
    support = cut(supports(records, "__items").where(F.col("n_item") >= floor))
    heavy = [r[0] for r in support.where(F.col("n_item") * max_heavy >= total["postings"]).select("item").sort("item").collect()]
    keep = at_most(support.select("item"), dictionary) if floor > 1 else None
    if keep is None and floor > 1:
        # numbered before the arrays are opened, and written, so that a retried task cannot number anew
        ids = cut(records.select("__items", F.monotonically_increasing_id().alias("__row"))).select("__row", F.explode(F.array_distinct("__items")).alias("item"))
        records = ids.join(support, "item", "left_semi").groupBy("__row").agg(F.collect_list("item").alias("__items"))
    counted = pair_counts(records, "__items", heavy, None if keep is None else sorted(r[0] for r in keep))
    counted = counted.where(F.col("n_ab") >= floor)
    return (
        counted.join(support.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a")), "item_a")
        .join(support.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b")), "item_b")
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(total["n"]).cast("long").alias("n"))
        .withColumn("lift", F.col("n") * F.col("n_ab").cast("double") / (F.col("n_a").cast("double") * F.col("n_b")))
    )

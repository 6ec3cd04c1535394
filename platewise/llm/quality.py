"""Per-document text quality statistics, outlier scores and the kind of text.

1. One pass over the characters of each Arrow batch measures its texts
   (:func:`statistics`), by array operations, not text by text.
2. Ranks are exact and per language (:func:`platewise.operators.ranks.ranks`): equal
   values are counted first, the distinct values are sorted by range partitioning, and
   partition offsets turn places into ranks.  A value that most documents share is one row.
3. A document's tail probability in a statistic is the share of its language at
   least as low (left) or as high (right); the outlier score is the largest of the
   summed negative logarithms of the left tails, of the right tails, and of the
   tails on the side to which each statistic is skewed.
4. A document is a candidate if its tails on the side away from prose are together no
   likelier than chance would have them: the negative logarithm of a uniform tail has
   the mean 1, so their sum must reach the number of those statistics, within the
   document's language or within all documents (ties count in a tail, so a small or
   homogeneous language alone has no unlikely ones).
5. Only the candidates are read line by line (:class:`platewise.llm.shape.Reader`); a
   candidate's kind is that of the greater part of its characters.

Defined results: null, empty and blank texts have zero words, null shares, no
ranks, no score and no kind.  A null, empty or ``und`` language is ranked within
all documents and read with the common words of all languages, like a language
without a word list.  A language is compared trimmed and in lower case.  A statistic
that a text does not have (the mean length of no words) counts as its mean, 1.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.shape import KINDS, Reader
from platewise.operators.ranks import ranks
from platewise.runtime import at_most, cut

#: statistics that are ranked, and the side of prose's opposite: 1 high, -1 low, 0 neither
RANKED = {
    "word_count": 0, "punct_line_share": 0, "mean_word_length": 1, "symbol_ratio": 1, "repeated_word_share": 1,
    "common_word_share": -1, "stop_rate": -1, "words_per_line": -1, "vowel_share": -1,
}
#: negative log of the chance from which on the tails away from prose make a candidate: its mean for uniform tails
CANDIDATE = float(sum(side != 0 for side in RANKED.values()))
ANY = "*"

COUNTS = ("n", "solid", "symbols", "letters", "vowels", "lines", "ended", "stops", "different", "common")
#: character classes and patterns: what is counted, as regular expressions would say it
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAKS = r"\n\r\x{85}\x{2028}\x{2029}"
WORDS = r"\p{L}+"
LINES = rf"[^{BREAKS}]*[^{SPACE}][^{BREAKS}]*"
ENDED = rf"""[.!?…。！？]["'”’»)\] \t\x{{a0}}\x{{3000}}]*(?:[{BREAKS}]|\z)"""
STOPS = rf"""[。！？]|[.!?…](?:["'”’»)\]{SPACE}]|\z)"""
VOWELS = "aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûü"


def language(lang: str) -> Column:
    """Trimmed lower-case language, :data:`ANY` where it says nothing."""
    name = F.coalesce(F.lower(F.trim(F.col(lang))), F.lit(""))
    return F.when(name.isin("", "und"), F.lit(ANY)).otherwise(name)


def word_lists(common: DataFrame, most_words: int = 100_000) -> dict[str, list[str]]:
    """Common words by language, and those of all languages under :data:`ANY`; refuses more than ``most_words`` rows."""
    rows = at_most(common.select(language("lang").alias("lang"), F.lower("word").alias("word")).where("word is not null").distinct(), most_words)
    if rows is None:
        raise ValueError(f"more than {most_words} common words")
    lists: dict[str, set[str]] = {ANY: set()}
    for r in rows:
        lists.setdefault(r["lang"], set()).add(r["word"])
        lists[ANY].add(r["word"])
    return {k: sorted(v) for k, v in sorted(lists.items())}


def _texts(column: pa.Array) -> list[str]:
    """Texts without nulls; bytes that are no text are replaced."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


LETTER, OTHER, BLANK, INLINE, BREAK, STOP, FULL_STOP, QUOTE, VOWEL = (1 << i for i in range(9))
PLANES = 0x20000
#: an odd number, whose powers and their inverses modulo 2 ** 64 weigh the places of letters
BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters of the first two planes: class bits, letters and vowels in one number, symbols and solid ones in another."""
    bits = np.zeros(PLANES, np.uint16)
    for i in range(PLANES):
        kind = unicodedata.category(chr(i))[0]
        bits[i] = LETTER if kind == "L" else OTHER if kind in "MN" else 0
    for classes, bit in ((SPACE, BLANK), (BREAKS, BREAK), (r" \t\x{a0}\x{3000}", INLINE), (".!?…。！？", STOP), ("。！？", FULL_STOP), ("""\"'”’»)\\]""", QUOTE), (VOWELS + VOWELS.upper(), VOWEL)):
        in_python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{m[1]:0>4}", classes)
        for m in re.finditer(f"[{in_python}]", "".join(map(chr, range(0x3100))) + "！？"):
            bits[ord(m[0])] |= bit
    has = lambda bit: (bits & bit != 0).astype(np.uint64)
    high = np.uint64(32)
    return bits, has(LETTER) | has(VOWEL) << high, (bits & (LETTER | OTHER | BLANK) == 0).astype(np.uint64) | (1 - has(BLANK)) << high


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    up = lambda base: np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))
    return up(BASE), up(pow(BASE, -1, 1 << 64))


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the characters from each start up to its end."""
    weigh, back = _powers(1 << max(16, int(len(low)).bit_length()))
    sums = np.cumsum((low.astype(np.uint64) + np.uint64(1)) * weigh[: len(low)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return (sums[ends - 1] - before) * back[starts]


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of lower-case words."""
    one, zero = np.array([0]), np.zeros(0, np.uint64)
    return np.unique(np.concatenate([zero, *(_hashes(np.array([ord(c) for c in w], np.uint32), one, np.array([len(w)])) for w in words if w)]))


def measure(texts: list[str], langs: list[str], lists: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The counts behind the statistics of a batch of texts, each an array with a value per text.

    The texts stand one after the other with a line break around each.
    """
    joined = "\n" + "\n".join(texts) + "\n"
    lowered = joined.lower()
    if len(lowered) != len(joined):  # a character whose lower case is longer stays as it is
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
    codes, low = (np.frombuffer(x.encode("utf-32-le", "replace"), np.uint32) for x in (joined, lowered))
    bits, letters_vowels, symbols_solid = _characters()
    if codes.max() >= PLANES:  # the next two planes are ideographs
        codes = np.where(codes < PLANES, codes, ord("一"))
    kind = bits[codes]
    upto = np.cumsum([len(t) + 1 for t in texts])
    docs = np.arange(len(texts))

    def per_text(at: np.ndarray) -> np.ndarray:
        """How many of some places, in order, each text has."""
        return np.diff(np.searchsorted(at, upto, "right"), prepend=np.searchsorted(at, 0, "right"))

    breaks = np.flatnonzero(kind & BREAK)
    # counts per line, then per text; the first line is the break before the first text
    line_starts = np.append(0, breaks[:-1] + 1)
    lv, ss = (np.add.reduceat(table[codes], line_starts) for table in (letters_vowels, symbols_solid))
    owner = np.searchsorted(upto, breaks)
    owner[0] = 0
    low_part, high_part = (lambda x: (x & np.uint64(0xFFFFFFFF)).astype(np.int64)), (lambda x: (x >> np.uint64(32)).astype(np.int64))
    summed = {n: np.bincount(owner, x, len(texts)).astype(np.int64) for n, x in {"letters": low_part(lv), "vowels": high_part(lv), "symbols": low_part(ss), "solid": high_part(ss), "lines": high_part(ss) > 0}.items()}
    # a line's last character but quotes and blanks
    at = breaks - 1
    going = np.flatnonzero(at > 0)
    while len(going := going[kind[at[going]] & (QUOTE | INLINE) != 0]):
        at[going] -= 1
    ended = breaks[(at > 0) & (kind[np.maximum(at, 0)] & STOP != 0)]
    stops = np.flatnonzero(kind & STOP)
    stops = stops[(kind[stops] & FULL_STOP != 0) | (kind[stops + 1] & (QUOTE | BLANK) != 0)]
    letter = kind & LETTER != 0
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1  # both ends of every word: breaks stand at both ends of all
    starts, ends = edges[::2], edges[1::2]
    n = per_text(starts)
    mine, hashes = np.repeat(docs, n), _hashes(low, starts, ends)
    _, first = np.unique(hashes + mine.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True)
    names = np.array([name if name in lists else ANY for name in langs], object)
    common = np.zeros(len(texts), np.int64)
    for name in set(names):
        own = (names == name)[mine]
        common += np.bincount(mine[own][np.isin(hashes[own], lists[name])], minlength=len(texts))
    return summed | {"n": n, "ended": per_text(ended), "stops": per_text(stops), "different": np.bincount(mine[first], minlength=len(texts)), "common": common}


def statistics(df: DataFrame, key: str, text: str, lang: str, common: DataFrame) -> DataFrame:
    """One row of statistics per document: ``(key, lang, word_count, ..., vowel_share)``.

    Words are runs of letters in lower case, lines those that are not blank.
    ``common`` is ``(lang, word)``, a word list whose size is checked.  No shuffle: a
    batch of texts is one array of characters, and each count one pass over it.
    """
    lists = word_lists(common)

    def run(batches):
        hashed = {name: word_hashes(words) for name, words in lists.items()}
        for batch in batches:
            texts, langs = _texts(batch.column(2)), batch.column(1).to_pylist()
            for at in range(0, batch.num_rows, 256):  # bounds the arrays' memory
                m = measure(texts[at : at + 256], langs[at : at + 256], hashed)
                piece = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(m[c].astype(np.int64)) for c in COUNTS)], names=["__key", "__lang", *COUNTS])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("__key"), language(lang).alias("__lang"), F.coalesce(text, F.lit("")).alias("__text"))
    out = out.mapInArrow(run, f"__key {kind}, __lang string, " + ", ".join(f"{c} long" for c in COUNTS))
    some, words = F.col("solid") > 0, F.greatest(F.col("n"), F.lit(1))
    shares = {
        "mean_word_length": F.try_divide(F.col("letters"), F.col("n")), "symbol_ratio": F.try_divide(F.col("symbols"), F.col("solid")),
        "punct_line_share": F.try_divide(F.col("ended"), F.col("lines")), "common_word_share": F.col("common") / words,
        "repeated_word_share": 1.0 - (F.col("different") + F.when(F.col("n") == 0, 1).otherwise(0)) / words, "stop_rate": F.col("stops") / words,
        "words_per_line": F.try_divide(F.col("n"), F.col("lines")), "vowel_share": F.try_divide(F.col("vowels"), F.col("letters")),
    }
    return out.select(F.col("__key").alias(key), F.col("__lang").alias("lang"), F.col("n").alias("word_count"), *(F.when(some, c.cast("double")).alias(s) for s, c in shares.items()))


def scores(stats: DataFrame, key: str, ranked: dict[str, int] = RANKED, hot: int = 64, most_hot: int = 200_000) -> DataFrame:
    """``(key, outlier_score, away_score)`` of the documents whose text is not blank.

    ``outlier_score`` is that within the document's language, ``away_score`` the larger
    of those within its language and within all documents.  A value that more than a
    ``hot``-th of a group has finds its tails in a broadcast of the counted hot values,
    so no task is given all documents that share one.
    """
    names = list(ranked)
    pairs = F.array(*(F.struct(F.lit(i).alias("stat"), F.col(s).cast("double").alias("value")) for i, s in enumerate(names)))
    docs = stats.where("symbol_ratio is not null")
    long = docs.select(F.col(key).alias("__key"), F.col("lang").alias("own"), F.inline(pairs)).where("value is not null")
    long = long.select("*", F.explode(F.array_distinct(F.array("own", F.lit(ANY)))).alias("grp"))
    ranked_values = ranks(long, ["grp", "stat"])
    moments = ranked_values.groupBy("grp", "stat").agg(
        (F.sum(F.col("value") * F.col("same")) / F.sum("same")).alias("mean"),
        F.max(F.when(F.col("below") * 2 <= F.col("total"), F.col("value"))).alias("median"),
    )
    tails = cut(ranked_values.join(moments, ["grp", "stat"]).select(
        "grp", "stat", "value", (F.col("same") * hot >= F.col("total")).alias("hot"),
        (-F.ln((F.col("below") + F.col("same")) / F.col("total"))).alias("low"),
        (-F.ln((F.col("total") - F.col("below")) / F.col("total"))).alias("high"),
        (F.col("median") - F.col("mean") > F.col("median") * 1e-9).alias("left_skewed"),  # sums differ in their last digits
    ))
    side = F.element_at(F.array(*(F.lit(v) for v in ranked.values())), F.col("stat") + 1)

    def tailed(rows: DataFrame) -> DataFrame:
        away = F.when(side == 1, F.col("high")).when(side == -1, F.col("low")).otherwise(F.lit(0.0))
        skewed = F.when(F.col("left_skewed"), F.col("low")).otherwise(F.col("high"))
        home, all_ = F.col("grp") == F.col("own"), F.col("grp") == ANY
        sums = {"low": F.when(home, F.col("low")), "high": F.when(home, F.col("high")), "skewed": F.when(home, skewed), "near": F.when(home, away), "far": F.when(all_, away)}
        counts = {"n_near": F.when(home & (side != 0), 1), "n_far": F.when(all_ & (side != 0), 1)}
        return rows.groupBy("__key").agg(*(F.sum(c).alias(s) for s, c in sums.items()), *(F.count(c).alias(s) for s, c in counts.items()))

    common, rest = tails.where("hot").drop("hot"), tails.where("not hot").drop("hot")
    if common.limit(most_hot + 1).count() <= most_hot:
        found = long.join(F.broadcast(common), ["grp", "stat", "value"], "left")
        cold = found.where("low is null").drop("low", "high", "left_skewed").join(rest, ["grp", "stat", "value"])
        parts = tailed(found.where("low is not null")).unionByName(tailed(cold))
    else:
        parts = tailed(long.join(tails, ["grp", "stat", "value"]))
    summed = parts.groupBy("__key").agg(*(F.sum(c).alias(c) for c in parts.columns if c != "__key"))
    directed = float(sum(v != 0 for v in ranked.values()))

    def whole(total: str, counted: str) -> Column:
        return F.coalesce(total, F.lit(0.0)) + (F.lit(directed) - F.col(counted))

    return summed.select(
        F.col("__key").alias(key), F.greatest("low", "high", "skewed").alias("outlier_score"),
        F.greatest(F.when(F.col("n_near") > 0, whole("near", "n_near")), F.when(F.col("n_far") > 0, whole("far", "n_far")), F.lit(0.0)).alias("away_score"),
    )


def kinds(df: DataFrame, scored: DataFrame, key: str, text: str, lang: str, common: DataFrame, candidate: float = CANDIDATE, most_ids: int = 4_000_000) -> DataFrame:
    """``(key, kind)`` of the candidates among the texts ``df`` whose greater part is not prose.

    The candidates' ids go to every task if their counted number allows, so the texts
    do not move; else both sides meet by key.  A document that is no candidate is not read.
    """
    lists = word_lists(common)
    ids = cut(scored.where(F.col("away_score") >= candidate).select(F.col(key).alias("__id")))
    few = ids.limit(most_ids + 1).count() <= most_ids

    def run(batches):
        readers: dict[str, Reader] = {}
        for batch in batches:
            kinds_ = []
            for name, t in zip(batch.column(1).to_pylist(), _texts(batch.column(2)), strict=True):
                name = name if name in lists else ANY
                if name not in readers:
                    readers[name] = Reader(lists[name])
                sizes, _ = readers[name].read(t)
                kinds_.append(max(KINDS, key=sizes.get))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds_, pa.string())], names=["__key", "kind"])

    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key).alias("__key"), language(lang).alias("__lang"), F.col(text).alias("__text"))
    texts = texts.join(F.broadcast(ids) if few else ids, F.col("__key") == F.col("__id"), "left_semi")
    return texts.mapInArrow(run, f"__key {kind}, kind string").where("kind <> 'prose'").withColumnRenamed("__key", key)

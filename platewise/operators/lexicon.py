"""Tag free text with layered term lexicons: flags, deciding layers, and their evaluation.

A lexicon is a table ``(class, layer, term)`` given by the caller, with exempt
phrases per class that are blanked, in order, before the class is matched.  Terms
are matched as substrings of the lower-case text.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    cls: str
    layer: str
    text: str
    ord: int


class Lexicon:
    """Terms per class, longest first, then by layer and position; ``exempt`` maps classes to phrases."""

    def __init__(self, rows, layers: tuple[str, ...] = ("direct", "derived", "composite"), exempt: dict[str, tuple[str, ...]] | None = None):
        by_class: dict[str, list[tuple[str, str]]] = {}
        for cls, layer, text in rows:
            by_class.setdefault(cls, []).append((layer, text.strip().lower()))
        self.layers = layers
        self.exempt = exempt or {}
        self.terms: dict[str, list[Term]] = {}
        for cls, found in by_class.items():
            placed = sorted(enumerate(found), key=lambda x: (-len(x[1][1]), layers.index(x[1][0]), x[0]))
            self.terms[cls] = [Term(cls, layer, text, i) for i, (_, (layer, text)) in enumerate(placed) if text]

    @classmethod
    def read(cls, path: str, exempt: dict[str, tuple[str, ...]] | None = None) -> Lexicon:
        """A lexicon of any size from a CSV file with columns class, layer, term."""
        with open(path, newline="", encoding="utf-8") as lines:
            return cls([(r["class"], r["layer"], r["term"]) for r in csv.DictReader(lines)], exempt=exempt)

    @property
    def classes(self) -> list[str]:
        return list(self.terms)

    def minimal(self, cls: str) -> list[str]:
        """Terms that contain no other term of their class: enough for the flag, not for the layer."""
        texts = list(dict.fromkeys(t.text for t in self.terms[cls]))
        return [t for t in texts if not any(o != t and o in t for o in texts)]

    def masked(self, text: Column, cls: str) -> Column:
        """Lower-case text with the class's exempt phrases blanked by as many spaces."""
        text = F.lower(text)
        for phrase in self.exempt.get(cls, ()):
            text = F.replace(text, F.lit(phrase), F.lit(" " * len(phrase)))
        return text

    def fires(self, text: Column, cls: str) -> Column:
        """Whether any term of the class occurs; false for null text."""
        masked, hit = self.masked(text, cls), F.lit(False)
        for term in self.minimal(cls):
            hit = hit | masked.contains(term)
        return F.coalesce(hit, F.lit(False))

    def layer(self, text: Column, cls: str) -> Column:
        """Layer of the longest term that occurs, or null."""
        masked = self.masked(text, cls)
        return F.coalesce(*(F.when(masked.contains(t.text), F.lit(t.layer)) for t in self.terms[cls]), F.lit(None).cast("string"))

    def table(self, spark: SparkSession) -> DataFrame:
        """The terms as a table ``(class, layer, term, ord)``."""
        return spark.createDataFrame([(t.cls, t.layer, t.text, t.ord) for ts in self.terms.values() for t in ts], "class string, layer string, term string, ord int")


def joined_text(items: str) -> Column:
    """Items of an array as one lower-case text."""
    return F.lower(F.array_join(items, " | "))


def flags(df: DataFrame, text: Column, lexicon: Lexicon) -> DataFrame:
    """Add a boolean column per class in one projection."""
    return df.withColumns({f"has_{c}": lexicon.fires(text, c) for c in lexicon.classes})


def matches(df: DataFrame, key: str, text: Column, lexicon: Lexicon) -> DataFrame:
    """``(key, class, layer)`` of the first matching term, by a join with the term table.

    The lexicon is a table the program holds in memory, so its broadcast is as small
    as that; the text is masked once per class before the join.
    """
    masks = F.array(*(F.struct(F.lit(c).alias("class"), lexicon.masked(text, c).alias("text")) for c in lexicon.classes))
    rows = df.select(F.col(key).alias("__key"), F.inline(masks))
    terms = F.broadcast(lexicon.table(df.sparkSession))
    hit = rows.join(terms, (rows["class"] == terms["class"]) & rows["text"].contains(terms["term"])).select("__key", terms["class"], "layer", "ord")
    return hit.groupBy("__key", "class").agg(F.min_by("layer", "ord").alias("layer")).withColumnRenamed("__key", key)


def confusion(df: DataFrame, group: str, predicted: str, truth: str) -> DataFrame:
    """Confusion counts with recall and precision per group, and over all (null group)."""
    p, t = F.col(predicted), F.col(truth)
    out = df.rollup(group).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    return out.withColumns({"recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), "precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))})


def stratified(df: DataFrame, strata: list[str], key: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each stratum by ``key``; the limit is applied before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("draw", F.row_number().over(Window.partitionBy(*strata).orderBy(key))).where(F.col("draw") <= n)

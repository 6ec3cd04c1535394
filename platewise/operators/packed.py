"""Split fields that hold several values in one string, keeping each value's position.

A finite-state tokenizer walks the field from one significant character to the
next.  Its states are START (before a value), BARE (inside an unquoted value),
QUOTED (inside quotes, where a backslash or a doubled quote may hide the closing
one) and AFTER (between a closing quote and the delimiter).  A depth counter
follows nested brackets, so a list that never closes is recognised.

Layouts, decided from the field's own text:

* list literal or JSON list, ``[...]``: strings in single or double quotes with
  backslash escapes, or bare values;
* tuple ``(...)``: only where the dialect names parentheses as brackets;
* anything else: delimited text in which only double quotes around a whole value
  are quotes, and two quotes inside them stand for one.

Defined results: a null, empty or blank field gives no values; empty pieces give
none and take no position; white space inside a value collapses to one space; a
field that opens ``[`` and does not end with ``]`` gives no values.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.runtime import cut

SPACES = re.compile(r"\s+")
ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))", re.S)
#: The one-letter escapes shared by list literals and JSON.
LETTERS = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "0": "\0", "\n": ""}


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code is None:
        return LETTERS.get(m[4], m[4])
    point = int(code, 16)
    return chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else "�"


def unescape(text: str) -> str:
    """Resolve backslash escapes; an unknown escape stands for its own character."""
    return ESCAPE.sub(_unescape, text) if "\\" in text else text


@dataclass(frozen=True)
class Dialect:
    """What separates and encloses values: ``delimiters`` is a regex character-class body."""

    delimiters: str
    parentheses: bool = False


#: Words and phrases: white space belongs to the value, line ends and tabs separate.
PHRASES = Dialect(r",;|\t\r\n")
#: Numbers: slashes and any white space separate as well; tuples are lists.
NUMBERS = Dialect(r",;|/\s", parentheses=True)


class Tokenizer:
    """The automaton for one dialect; each state has a scanner that skips a whole run."""

    def __init__(self, dialect: Dialect):
        d = dialect.delimiters
        self.parentheses = dialect.parentheses
        self.is_delimiter = re.compile(f"[{d}]").match
        self.gap = re.compile(rf"(?:(?![{d}])\s)*").match
        self.bare = re.compile(f"[^{d}]*").match
        self.single = re.compile(r"'((?:[^'\\]|\\.)*)'", re.S).match
        self.double = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S).match
        self.whole = re.compile(rf'"((?:[^"]|"")*)"(?=(?:(?![{d}])\s)*(?:[{d}]|\Z))').match

    def split(self, field: str | None) -> list[str]:
        if not field:
            return []
        if field[0] == "[":
            end = field.rstrip()
            return self._literal(end[1:-1]) if len(end) > 1 and end[-1] == "]" else []
        body = field.strip()
        if self.parentheses and body[:1] == "(" and body[-1:] == ")":
            return self._literal(body[1:-1])
        return self._delimited(field)

    def _literal(self, s: str) -> list[str]:
        out, i, n, depth = [], 0, len(s), 1
        while i < n:
            i = self.gap(s, i).end()  # START
            if i >= n:
                break
            ch = s[i]
            if ch == "[":
                depth += 1
                i += 1
                continue
            m = self.single(s, i) if ch == "'" else self.double(s, i) if ch == '"' else None
            if m:  # QUOTED, then AFTER
                value, i = unescape(m[1]), m.end()
                tail = self.bare(s, i)
                depth -= tail[0].count("]")
                i = tail.end() + 1
            else:  # BARE
                m = self.bare(s, i)
                value, i = m[0], m.end() + 1
                while depth > 1 and value.rstrip().endswith("]"):
                    value, depth = value.rstrip()[:-1], depth - 1
            value = SPACES.sub(" ", value).strip()
            if value:
                out.append(value)
        return out

    def _delimited(self, s: str) -> list[str]:
        out, i, n = [], 0, len(s)
        while i < n:
            i = self.gap(s, i).end()
            m = self.whole(s, i) if i < n and s[i] == '"' else None
            if m:
                value, i = m[1].replace('""', '"'), self.gap(s, m.end()).end() + 1
            else:
                m = self.bare(s, i)
                value, i = m[0], m.end() + 1
            value = SPACES.sub(" ", value).strip()
            if value:
                out.append(value)
        return out


def split_packed(column: Column | str, dialect: Dialect = PHRASES) -> Column:
    """Array of the values packed in a string column; empty array for null."""
    tokenizer = Tokenizer(dialect)

    @F.arrow_udf("array<string>")
    def run(fields: pa.Array) -> pa.Array:
        lists = [tokenizer.split(x) for x in fields.to_pylist()]
        ends = [0]
        for x in lists:
            ends.append(ends[-1] + len(x))
        values = pa.array([v for x in lists for v in x], pa.string())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return run(F.col(column) if isinstance(column, str) else column)


def _by_key(df: DataFrame, key: str, fields: dict[str, Dialect]) -> tuple[DataFrame, DataFrame]:
    """``(__key, field, vals)`` of the rows whose key stands alone, and of those whose key is repeated or null.

    Only the keys move to tell them apart, and each field is split once.
    """
    packed = df.select(F.col(key).alias("__key"), *(F.col(f).alias(f"__f{i}") for i, f in enumerate(fields)))
    often = cut(packed.groupBy(F.col("__key").alias("__often")).agg(F.count("*").alias("n")).where("n > 1 and __often is not null").select("__often"))

    def split(rows: DataFrame) -> DataFrame:
        values = rows.select("__key", *(split_packed(f"__f{i}", dialect).alias(f"__f{i}") for i, dialect in enumerate(fields.values())))
        entries = F.array(*(F.struct(F.lit(name).alias("field"), F.col(f"__f{i}").alias("vals")) for i, name in enumerate(fields)))
        return values.select("__key", F.inline(entries))

    alone = packed.where("__key is not null").join(often, F.col("__key") == F.col("__often"), "left_anti")
    many = packed.join(often, F.col("__key") == F.col("__often"), "left_semi").unionByName(packed.where("__key is null"))
    return split(alone), split(many)


def explode_packed(df: DataFrame, key: str, fields: dict[str, Dialect]) -> DataFrame:
    """One row ``(key, field, pos, val)`` per packed value, each once per key.

    Rows whose key stands alone do not move.  Of repeated keys, repeats are removed
    inside each task first and then over all four columns, so the shuffle spreads even
    a key that holds a third of the rows.  A null key counts as one key.  Other columns
    are ignored.
    """
    alone, many = (rows.select("__key", "field", F.posexplode("vals").alias("pos", "val")) for rows in _by_key(df, key, fields))
    return alone.unionByName(many.dropDuplicates(["__key", "field", "pos", "val"])).withColumnRenamed("__key", key)


def packed_values(df: DataFrame, key: str, fields: dict[str, Dialect]) -> DataFrame:
    """One row ``(key, field, val)`` per different value of a key's field, like :func:`explode_packed` without places."""
    alone, many = (rows.select("__key", "field", F.explode(F.array_distinct("vals")).alias("val")) for rows in _by_key(df, key, fields))
    return alone.unionByName(many.distinct()).withColumnRenamed("__key", key)


RECIPE_FIELDS = {"ingredients": PHRASES, "tags": PHRASES, "nutrition": NUMBERS}

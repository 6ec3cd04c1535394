"""Load delimited text records and report why a record cannot be loaded.

The grammar is parsed by recursive descent over terminals that are regular
expressions::

    text    := record (newline record)*
    record  := field ("," field)*
    field   := '"' (char | '""')* '"'  followed by "," or the record's end
             | run of characters without quote and comma
    numbers := "[" number ("," number)* "]"
    strings := "[" string ("," string)* "]"

A syntax error carries its place (field number and character offset).  After a
broken quote the parser gives up the current record and resumes at the next
*record-start anchor*: a line start at which the leading fields are valid for
the schema (:attr:`Grammar.anchor`), so text after the fault is not swallowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.packed import unescape

#: The columns of a recipe record, in file order.
RECIPE_COLUMNS = (
    "name", "id", "minutes", "contributor_id", "submitted", "tags",
    "nutrition", "n_steps", "steps", "description", "ingredients", "n_ingredients",
)

QUOTED = re.compile(r'"([^"]*(?:""[^"]*)*)"(?=,|\Z)')
PLAIN = re.compile(r'[^",]*')
SPACE = re.compile(r"\s*")
NUMBER = re.compile(r"\d+(?:\.\d+)?", re.A)
STRING = re.compile(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\"""", re.S)


@dataclass
class SyntaxFault(Exception):
    """Why parsing stopped: ``reason``, 1-based ``field`` and 0-based ``offset`` in the record."""

    reason: str
    field: int
    offset: int
    detail: str


@dataclass
class Parsed:
    """A record's fields, or the fault that stopped it, and the text it was read from."""

    text: str
    fields: list[str]
    fault: SyntaxFault | None
    numbers: list[float] | None = None
    strings: list[str] | None = None


def _bracketed(text: str, element, reason: str, field: int) -> list:
    """``"[" element ("," element)* "]"`` with white space around brackets and elements."""
    i = SPACE.match(text, 0).end()
    if text[i : i + 1] != "[":
        raise SyntaxFault(reason, field, i, "no opening bracket")
    out, i = [], i + 1
    while True:
        value, i = element(text, SPACE.match(text, i).end())
        out.append(value)
        i = SPACE.match(text, i).end()
        ch = text[i : i + 1]
        i += 1
        if ch == "]":
            break
        if ch != ",":
            raise SyntaxFault(reason, field, i - 1, "no comma or closing bracket after an element")
    if SPACE.match(text, i).end() != len(text):
        raise SyntaxFault(reason, field, i, "text after the closing bracket")
    return out


def parse_numbers(text: str, field: int = 7, count: int = 7) -> list[float]:
    """Exactly ``count`` plain decimal numbers in one pair of square brackets."""

    def element(s: str, i: int):
        m = NUMBER.match(s, i)
        if not m:
            raise SyntaxFault("nutrition", field, i, "not a plain number")
        return float(m[0]), m.end()

    out = _bracketed(text, element, "nutrition", field)
    if len(out) != count:
        raise SyntaxFault("nutrition", field, len(text), f"{len(out)} numbers instead of {count}")
    return out


def parse_strings(text: str, field: int = 11) -> list[str]:
    """One or more quoted strings, none blank, in one pair of square brackets."""

    def element(s: str, i: int):
        m = STRING.match(s, i)
        if not m:
            raise SyntaxFault("ingredients", field, i, "not a quoted string")
        value = unescape(m[1] if m[1] is not None else m[2])
        if not value.strip():
            raise SyntaxFault("ingredients", field, i, "a blank string")
        return value, m.end()

    return _bracketed(text, element, "ingredients", field)


class Grammar:
    """A record grammar for a fixed list of columns, with the two validated fields of a recipe."""

    def __init__(self, columns: tuple[str, ...] = RECIPE_COLUMNS, numbers: str = "nutrition", strings: str = "ingredients"):
        self.columns = columns
        self.numbers = columns.index(numbers)
        self.strings = columns.index(strings)
        #: a line start with a name (quoted, or any run without a comma) and whole numbers in the next two fields
        self.anchor = re.compile(r'(?:\A|\r\n|\n|\r)(?=(?:"[^"]*(?:""[^"]*)*"|[^",\r\n][^,\r\n]*|),"?\d+"?,"?\d+"?,)')

    def fields(self, text: str) -> list[str]:
        out, i = [], 0
        while True:
            value, i = self._field(text, i, len(out) + 1)
            out.append(value)
            if i >= len(text):
                return out
            i += 1  # the comma that both kinds of field stop at

    def _field(self, text: str, i: int, number: int) -> tuple[str, int]:
        if text.startswith('"', i):
            m = QUOTED.match(text, i)
            if not m:
                raise SyntaxFault("quoting", number, i, "the quoted field does not close before a comma or the end")
            return m[1].replace('""', '"'), m.end()
        m = PLAIN.match(text, i)
        if m.end() < len(text) and text[m.end()] == '"':
            raise SyntaxFault("quoting", number, m.end(), "a quote inside an unquoted field")
        return m[0], m.end()

    def record(self, text: str | None) -> Parsed:
        """Parse one record; the first fault in the order quoting, columns, numbers, strings is kept."""
        text = text or ""
        out = Parsed(text, [], None)
        try:
            out.fields = self.fields(text)
            if len(out.fields) != len(self.columns):
                raise SyntaxFault("column_count", len(out.fields), len(text), f"{len(out.fields)} columns instead of {len(self.columns)}")
            out.numbers = parse_numbers(out.fields[self.numbers], self.numbers + 1)
            out.strings = parse_strings(out.fields[self.strings], self.strings + 1)
        except SyntaxFault as fault:
            out.fault = fault
        return out

    def text(self, text: str | None) -> Iterator[tuple[int, Parsed]]:
        """Records of a text of many lines with their offsets, resuming at anchors after broken quotes."""
        text, i = text or "", 0
        while i < len(text):
            end, broken = self._extent(text, i)
            if broken:
                later = self.anchor.search(text, i + 1)
                end = later.start() if later else len(text)
            if body := text[i:end].rstrip("\r\n"):
                yield i, self.record(body)
            i = end
            while i < len(text) and text[i] in "\r\n":
                i += 1

    def _extent(self, text: str, i: int) -> tuple[int, bool]:
        """Where the record that starts at ``i`` ends, and whether its quoting is broken."""
        while True:
            if text.startswith('"', i):
                m = re.compile(r'"[^"]*(?:""[^"]*)*"(?=,|\r|\n|\Z)').match(text, i)
                if not m:
                    return i, True
                i = m.end()
            else:
                m = re.compile(r'[^",\r\n]*').match(text, i)
                i = m.end()
                if text.startswith('"', i):
                    return i, True
            if i >= len(text) or text[i] in "\r\n":
                return i, False
            i += 1


_LONGS = ("id", "minutes", "contributor_id", "n_steps", "n_ingredients")
_OUT = pa.schema(
    [("__key", pa.int64()), ("offset", pa.int64()), ("reason", pa.string()), ("field_no", pa.int32()), ("char_no", pa.int64()), ("detail", pa.string())]
    + [(c, pa.int64() if c in _LONGS else pa.string()) for c in RECIPE_COLUMNS if c not in ("nutrition", "ingredients")]
    + [("nutrition", pa.list_(pa.float64())), ("ingredients", pa.list_(pa.string()))]
)
_DDL = (
    "__key long, offset long, reason string, field_no int, char_no long, detail string, "
    + ", ".join(f"{c} {'long' if c in _LONGS else 'string'}" for c in RECIPE_COLUMNS if c not in ("nutrition", "ingredients"))
    + ", nutrition array<double>, ingredients array<string>"
)


def _long(text: str) -> int | None:
    """A 64-bit whole number, or null; the unchecked columns never reject a record."""
    text = text.strip()
    if not re.fullmatch(r"[+-]?\d{1,18}", text, re.A):
        return None
    return int(text)


def _row(key, offset: int, p: Parsed) -> dict:
    row = {"__key": key, "offset": offset}
    if p.fault:
        return row | {"reason": p.fault.reason, "field_no": p.fault.field, "char_no": p.fault.offset, "detail": p.fault.detail}
    for name, value in zip(RECIPE_COLUMNS, p.fields, strict=True):
        row[name] = _long(value) if name in _LONGS else value
    return row | {"nutrition": p.numbers, "ingredients": p.strings}


def parse_records(df: DataFrame, key: str, text: str, many: bool = False) -> DataFrame:
    """Every record of ``df`` as a typed row or as a row with the reason it failed.

    ``reason`` is null for a loaded record.  With ``many`` each ``text`` may hold
    several records and ``offset`` tells them apart; without it each row is one
    record.  A null text is an empty record (one column).  Only ``key`` and
    ``text`` are read, so further columns may have any name.  No shuffle.
    """

    def run(batches):
        grammar = Grammar()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for k, t in zip(keys, texts, strict=True):
                if many:
                    rows.extend(_row(k, at, p) for at, p in grammar.text(t))
                else:
                    rows.append(_row(k, 0, grammar.record(t)))
            if rows:
                yield from pa.Table.from_pylist(rows, _OUT).to_batches()

    parsed = df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).mapInArrow(run, _DDL)
    return parsed.withColumnRenamed("__key", key)


def rejected(parsed: DataFrame) -> DataFrame:
    """The failed records: everything but the typed columns."""
    return parsed.where("reason is not null").drop(*RECIPE_COLUMNS)


def loaded(parsed: DataFrame) -> DataFrame:
    """The loaded records: everything but the fault columns."""
    return parsed.where("reason is null").drop("reason", "field_no", "char_no", "detail")

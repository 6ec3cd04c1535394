import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platewise.operators.packed import NUMBERS, PHRASES, RECIPE_FIELDS, SPACES, Tokenizer, explode_packed, unescape

CASES = [
    (None, []), ("", []), ("   ", []), ("[]", []), ("[ ]", []),
    ("['a', \"b c\"]", ["a", "b c"]), ('["a" , "b"]', ["a", "b"]), ("['it\\'s', 'x\\xa0y']", ["it's", "x y"]), ("['8\" cut', 'b']", ['8" cut', "b"]),
    ("['a, b; c', 'd']", ["a, b; c", "d"]), ("['a', 'b", []), ("['a'", []), ("[a, b]", ["a", "b"]), ("[['a', 'b'], ['c']]", ["a", "b", "c"]), ("['a', '', ' ', 'b']", ["a", "b"]),
    ("a;b |c\td\r\ne", ["a", "b", "c", "d", "e"]), (" , a,, b ,", ["a", "b"]), ('"8"" cut olive oil", salt', ['8" cut olive oil', "salt"]), ('"a; b";c', ["a; b", "c"]),
    ('8" cut, b', ['8" cut', "b"]), ('"open, b', ['"open', "b"]), ("egg / eggs, salt", ["egg / eggs", "salt"]), ("a  b c", ["a b c"]), ("x [divided], y", ["x [divided]", "y"]),
    ("['\\u00e9t\\u00e9']", ["été"]),
]


@pytest.mark.parametrize("text,values", CASES)
def test_phrases(text, values):
    assert Tokenizer(PHRASES).split(text) == values


@pytest.mark.parametrize(
    "text,values",
    [("(1.0, 2)", ["1.0", "2"]), ("1/2 3;4|5\t6 7", list("1234567")), ("['1.0', \"2.0\"]", ["1.0", "2.0"]), ("[1.0, 2.0", []), ("1 / 2 / 3", ["1", "2", "3"])],
)
def test_numbers(text, values):
    assert Tokenizer(NUMBERS).split(text) == values


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cc")), max_size=12), max_size=6))
def test_a_python_list_comes_back(values):
    want = [c for c in (SPACES.sub(" ", v).strip() for v in values) if c]
    assert Tokenizer(PHRASES).split(repr(values)) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cc")), min_size=1, max_size=12), min_size=1, max_size=6))
def test_quoted_delimited_values_come_back(values):
    want = [c for c in (SPACES.sub(" ", v).strip() for v in values) if c]
    assert Tokenizer(PHRASES).split(";".join('"' + v.replace('"', '""') + '"' for v in values)) == want


def test_long_fields_are_read_whole():
    assert len(Tokenizer(PHRASES).split(", ".join(f"v{i}" for i in range(200_000)))) == 200_000


def test_unknown_escape_is_its_character():
    assert unescape(r"a\qb\ud800") == "aqb�"


def test_rows_are_exploded_once_per_key(spark):
    rows = [(1, "['a', 'b']", "x;y", "1 2", "z"), (1, "a, b", "x|y|w", "1,2", "z"), (2, None, "", "[1", "z"), (None, "c", None, None, "z")]
    df = spark.createDataFrame(rows, "id long, ingredients string, tags string, nutrition string, pos string")
    got = {tuple(r) for r in explode_packed(df, "id", RECIPE_FIELDS).collect()}
    assert got == {
        (1, "ingredients", 0, "a"), (1, "ingredients", 1, "b"), (1, "tags", 0, "x"), (1, "tags", 1, "y"), (1, "tags", 2, "w"),
        (1, "nutrition", 0, "1"), (1, "nutrition", 1, "2"), (None, "ingredients", 0, "c"),
    }
    assert explode_packed(df.limit(0), "id", RECIPE_FIELDS).count() == 0


def test_repeated_and_null_keys(spark):
    from platewise.operators.packed import PHRASES, explode_packed, packed_values

    rows = [(1, "a, b"), (1, "['a', 'b']"), (1, "a,c"), (2, "x, x"), (None, "q"), (None, "q"), (None, "r"), (3, None)]
    df = spark.createDataFrame(rows, "id long, tags string")
    got = sorted((r["id"] or 0, r["pos"], r["val"]) for r in explode_packed(df, "id", {"tags": PHRASES}).collect())
    assert got == [(0, 0, "q"), (0, 0, "r"), (1, 0, "a"), (1, 1, "b"), (1, 1, "c"), (2, 0, "x"), (2, 1, "x")]
    assert sorted((r["id"] or 0, r["val"]) for r in packed_values(df, "id", {"tags": PHRASES}).collect()) == [(0, "q"), (0, "r"), (1, "a"), (1, "b"), (1, "c"), (2, "x")]
    assert explode_packed(df.limit(0), "id", {"tags": PHRASES}).count() == 0

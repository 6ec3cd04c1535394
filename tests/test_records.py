import pytest

from platewise.operators.records import Grammar, RECIPE_COLUMNS, loaded, parse_records, rejected

NUTRITION = '"[1, 2.5, 3, 4, 5, 6, 7]"'


def line(nutrition=NUTRITION, ingredients="\"['a', 'b']\"", name="soup", extra=""):
    return f"{name},1,2,3,2001-01-01,\"['t']\",{nutrition},1,\"['s']\",text,{ingredients},2{extra}"


@pytest.mark.parametrize(
    "text,reason",
    [
        (line(), None), (line(name='"a ""b"", c"'), None), (line(name='"two\nlines"'), None), (line(ingredients="\"[ 'it\\'s' , \"\"b\"\" ]\""), None),
        (line(name='a "b"'), "quoting"), (line(name='"a" b'), "quoting"), (line(name='"open'), "quoting"), (line(name='"a\\""'), "quoting"),
        (line(extra=",x"), "column_count"), ("", "column_count"), (None, "column_count"), ("a,b", "column_count"),
        (line(nutrition='"[1, 2, 3]"'), "nutrition"), (line(nutrition='"[1, 2, 3, 4, 5, 6, -7]"'), "nutrition"), (line(nutrition='"(1, 2, 3, 4, 5, 6, 7)"'), "nutrition"),
        (line(nutrition='"[1, 2, 3, 4, 5, 6, 7.]"'), "nutrition"), (line(nutrition='" [ 1,2 , 3,4,5,6,7 ] "'), None), (line(nutrition='"[1, 2, 3, 4, 5, 6, 7] x"'), "nutrition"),
        (line(ingredients='"[]"'), "ingredients"), (line(ingredients="\"['a', ' ']\""), "ingredients"), (line(ingredients="\"['a' 'b']\""), "ingredients"),
        (line(ingredients="\"['a', 1]\""), "ingredients"), (line(ingredients="\"['a'\""), "ingredients"), (line(ingredients="\"['chef's']\""), "ingredients"),
        (line(nutrition="x", ingredients="x"), "nutrition"), (line(nutrition="x", name='a"'), "quoting"),
    ],
)
def test_first_reason(text, reason):
    fault = Grammar().record(text).fault
    assert (fault.reason if fault else None) == reason


def test_faults_are_located():
    fault = Grammar().record(line(name='a "b"')).fault
    assert (fault.field, fault.offset) == (1, 2)
    fault = Grammar().record(line(nutrition='"[1, x]"')).fault
    assert (fault.field, fault.offset) == (7, 4)


def test_parsing_resumes_at_the_next_record_start():
    text = "\r\n".join([line(name="one"), line(name='"broken'), "rest of it", line(name='"two\nlines"'), line(name='bad "quote'), line(name="last")])
    found = list(Grammar().text(text))
    assert [p.fault.reason if p.fault else p.fields[0] for _, p in found] == ["one", "quoting", "two\nlines", "quoting", "last"]
    assert all(text[at : at + 3] == p.text[:3] for at, p in found)
    assert list(Grammar().text(None)) == []


def test_long_records():
    text = line(name='"' + "x" * 2_000_000 + '"', ingredients='"[' + ",".join(["'a'"] * 50_000) + ']"')
    assert len(Grammar().record(text).strings) == 50_000


def test_typed_rows_and_reasons(spark):
    rows = [(1, line(), "r"), (2, line(name='a"'), "r"), (3, None, None), (4, line(), "r")]
    parsed = parse_records(spark.createDataFrame(rows, "line_no long, raw_line string, reason string"), "line_no", "raw_line")
    good = {r["line_no"]: r for r in loaded(parsed).collect()}
    assert set(good) == {1, 4} and good[1]["nutrition"] == [1, 2.5, 3, 4, 5, 6, 7] and good[1]["ingredients"] == ["a", "b"] and good[1]["id"] == 1
    assert {(r["line_no"], r["reason"]) for r in rejected(parsed).collect()} == {(2, "quoting"), (3, "column_count")}
    assert set(RECIPE_COLUMNS) <= set(loaded(parsed).columns)
    assert parse_records(spark.createDataFrame([], "line_no long, raw_line string"), "line_no", "raw_line").count() == 0


def test_many_records_in_a_row(spark):
    df = spark.createDataFrame([(7, line() + "\n" + line(name="b")), (8, "")], "k long, t string")
    assert sorted((r["k"], r["offset"]) for r in parse_records(df, "k", "t", many=True).collect()) == [(7, 0), (7, len(line()) + 1)]


def test_blocks_of_text_hold_every_record(spark, data):
    from pyspark.sql import functions as F

    from platewise.plans import loading

    lines = spark.read.parquet(f"{data}/recipe_lines.parquet").where("raw_line is not null")
    faulty = loading.p2_found(spark, data).count()
    one = loading.p2_text(spark, data).agg(F.sum("lines").alias("lines"), F.sum("records").alias("records"), F.sum(F.col("quoting") + F.col("column_count") + F.col("nutrition") + F.col("ingredients")).alias("faults")).first()
    assert one["lines"] == lines.count()
    # a broken quote may hide its own end, never a record that starts with valid fields
    assert abs(one["records"] - one["lines"]) <= faulty and one["records"] - one["faults"] >= 0.95 * (one["lines"] - faulty)

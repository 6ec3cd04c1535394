from test_canonical import MAP

from platewise.llm import canonical as C


def mapped(spark, strings, more=()):
    values = spark.createDataFrame(list(enumerate(strings)), "id long, val string")
    mapping = spark.createDataFrame([*MAP, *more], "raw_ingr string, replaced string")
    return {r["val"]: r["replaced"] for r in C.map_values(values, mapping).collect()}


def test_a_string_is_mapped_alike_alone_and_among_others(spark):
    want = {
        "slat at room temperature": "salt", "slat cut in strips by Stukoupen": "salt", "Quoustouthow slat": "salt", "love and patience": "unmatched", "QUOUSTOUTHOW SLAT": "unmatched",
    }
    others = ["salt and patience", "egg patience", "quoustouthow salt", "ham hock cut in strips"]
    assert mapped(spark, want) == want
    assert {k: v for k, v in mapped(spark, [*want, *others]).items() if k in want} == want


def test_windows_are_as_long_as_the_longest_entry(spark):
    long = "salt of the very deep blue sea"
    got = mapped(spark, [f"2 cups {long} (optional)", "salt of the very deep blu sea", "salt"], [("n", long)])
    assert got == {f"2 cups {long} (optional)": long, "salt of the very deep blu sea": long}

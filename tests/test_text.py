import re

import pytest
from pyspark.sql import functions as F

from platewise.functions import nutrition as N
from platewise.functions import text as T
from platewise.operators import lexicon as L


@pytest.mark.parametrize("term,stem", [("oats", "oat"), ("olives", "oliv"), ("peas", "pea"), ("goat cheese", "goat cheese"), ("", ""), ("  Green  Peas ", "green pea"), ("gas", "gas")])
def test_exclusion_stem(term, stem):
    assert T.exclusion_stem(term) == stem


@pytest.mark.parametrize("text,hit", [("oatmeal", True), ("rolled oats | salt", True), ("goat cheese", False), (None, False)])
def test_exclusion(spark, text, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.excluded(F.col("t"), "oats")).first()[0] is hit
    assert df.select(T.excluded(F.col("t"), " ")).first()[0] is False


def test_servings_round_halves_to_even(spark):
    rows = [(100.0, 125.0, 1.0), (100.0, 175.0, 1.5), (0.0, 500.0, 1.0), (100.0, 10.0, 0.5), (100.0, 75.0, 1.0)]
    df = spark.createDataFrame(rows, "kcal double, target double, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", N.servings(F.col("kcal"), F.col("target"))).collect())


def test_slugs_escapes_and_notes(spark):
    df = spark.createDataFrame([("  A*b & C! ", 7, "fine"), (None, 8, ""), ("!!!", 9, "This will cure you")], "t string, id long, n string")
    r = df.select(T.slug(F.col("t"), F.col("id")).alias("s"), T.escape_markdown(F.col("t")).alias("e"), T.safe_note(F.col("n"), ("cure",), 10).alias("ok")).collect()
    assert [x["s"] for x in r] == ["a-b-c-7", None, "-9"] and r[0]["e"] == r"  A\*b & C\! " and [x["ok"] for x in r] == [True, False, False]


def test_scaling_and_gates(spark):
    df = spark.createDataFrame([(0.5, 0.2, 0.9, 2.0)], "energy double, macros double, repetition double, time double")
    p = {n: F.col(n) for n in df.columns}
    assert [df.select(N.admissible(p, i)).first()[0] for i in range(5)] == [False, False, False, False, True]
    assert N.relaxed_weights(2) == N.WEIGHTS | {"time": 0.0, "repetition": 0.0}
    assert df.select(N.scaled_relevance(F.lit(3.0), F.lit(3.0), F.lit(3.0))).first()[0] == 0.5


LEX = L.Lexicon(
    [("milk", "direct", "milk"), ("milk", "composite", "milk chocolate"), ("milk", "derived", "whey "), ("gluten", "direct", "oat "), ("gluten", "derived", "flour"), ("egg", "direct", "egg")],
    exempt={"milk": ("coconut milk",), "egg": ("eggplant",)},
)


def scalar(text, cls):
    text = (text or "").lower()
    for phrase in LEX.exempt.get(cls, ()):
        text = text.replace(phrase, " " * len(phrase))
    return next((t.layer for t in LEX.terms[cls] if t.text in text), None)


def test_lexicon_agrees_with_a_scalar_reading(spark):
    texts = ["goat cheese", "coconut milk", "coconut milk | milk", "milk chocolate", "EGGPLANT", "eggs", "gluten-free flour", "wheyprotein", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    flags = {r["id"]: r for r in L.flags(df, F.col("text"), LEX).collect()}
    layers = {r["id"]: r for r in df.select("id", *(LEX.layer(F.col("text"), c).alias(c) for c in LEX.classes)).collect()}
    joined = {(r["id"], r["class"]): r["layer"] for r in L.matches(df, "id", F.col("text"), LEX).collect()}
    for i, text in enumerate(texts):
        for c in LEX.classes:
            want = scalar(text, c)
            assert layers[i][c] == want and flags[i][f"has_{c}"] is (want is not None) and joined.get((i, c)) == want, (text, c)
    assert LEX.minimal("milk") == ["milk", "whey"]


def test_lexicon_from_a_file(tmp_path):
    (tmp_path / "l.csv").write_text("class,layer,term\nnut,direct,Almond \nnut,composite,marzipan\n")
    assert [t.text for t in L.Lexicon.read(str(tmp_path / "l.csv")).terms["nut"]] == ["marzipan", "almond"]


def test_confusion_has_a_total(spark):
    df = spark.createDataFrame([("a", True, True), ("a", True, False), ("b", False, True), ("b", False, False)], "c string, p boolean, t boolean")
    rows = {r["c"]: (r["tp"], r["fp"], r["fn"], r["tn"], r["recall"]) for r in L.confusion(df, "c", "p", "t").collect()}
    assert rows == {"a": (1, 1, 0, 0, 1.0), "b": (0, 0, 1, 1, 0.0), None: (1, 1, 1, 1, 0.5)}


def test_pattern_is_a_plain_regex():
    assert re.search(T.exclusion_pattern("a.b"), "a.bc") and not re.search(T.exclusion_pattern("a.b"), "axb")

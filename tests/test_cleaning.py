import pytest
from pyspark.sql import functions as F

from platewise.operators import cleaning as C
from platewise.operators import profiling as P


def items(spark, rows):
    ddl = "id long, name string, minutes long, n_steps int, n_ingredients int, tags string, nutrition string"
    return C.with_slots(C.with_nutrition(C.with_tags(spark.createDataFrame(rows, ddl))))


GOOD = "[100.0, 10, 20, 30, 40, 50, 60]"


def test_nutrition_becomes_mass(spark):
    r = items(spark, [(1, "a", 10, 1, 2, "['lunch']", GOOD), (2, "a", 10, 1, 2, None, "[1, 2]"), (3, "a", 1, 1, 2, "x", "1|2|3|4|5|6|b")]).orderBy("id").collect()
    assert (r[0]["calories"], r[0]["fat_g"], r[0]["sodium_mg"], r[0]["carbs_g"]) == (100.0, 6.5, 720.0, 180.0)
    assert r[1]["calories"] is None and r[2]["satfat_g"] is None


def test_rules_attribute_each_row_once(spark):
    rows = [
        (1, None, 0, 0, 1, "lunch", "x"), (2, "a", 1440, 1, 2, "lunch", GOOD), (3, "a", 1441, 1, 2, "lunch", GOOD), (4, "a", 10, 1, 2, "desserts, lunch", GOOD),
        (5, "a", 10, 1, 2, "rice", GOOD), (6, "a", 2147483647, 0, 2, "dinner-party", "[2000.1,0,0,0,0,0,0]"), (7, "a", 10, 1, 2, "brunch", "[0,0,0,0,0,0,0]"), (8, "a", None, None, None, "brunch", GOOD),
    ]
    df = items(spark, rows)
    found = {r["rule"]: (r["matched"], r["newly"]) for r in C.waterfall(df, C.item_rules()).collect()}
    assert found["missing name"] == (1, 1) and found["malformed nutrition"] == (1, 0) and found["minutes over 1440"] == (2, 1)
    assert found["no slot"] == (2, 2) and found["no calories"] == (1, 1) and sum(n for _, n in found.values()) == 6
    kept = {r["id"] for r in df.where(C.first_rule(C.item_rules()).isNull()).collect()}
    assert kept == {2, 8}
    assert {r["id"] for r in C.side_pool(df).collect()} == {5}
    assert {r["rule"]: r["newly"] for r in C.waterfall(df.limit(0), C.item_rules()).collect()}["no slot"] == 0


def test_normalise(spark):
    mapping = spark.createDataFrame([("Salts", "Salt"), ("x", None), ("oils", "Olive Oil"), ("oils", "Olive Oil")], "raw_ingr string, replaced string")
    df = spark.createDataFrame([(1, [" SALTS", "olive oil", "x"]), (2, None), (3, []), (4, [None, "salt", "salt"])], "k long, items array<string>")
    got = {r["k"]: (r["norm"], r["has_unmappable"]) for r in C.normalise(df, "k", "items", mapping).collect()}
    assert got == {1: (["salt", "olive oil", "x"], True), 2: ([], False), 3: ([], False), 4: (["salt", "salt"], False)}


def test_reconcile(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "label string, value long")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "label string, value long")
    assert {r["label"]: r["agrees"] for r in C.reconcile(a, b).collect()} == {"x": True, "y": False, "z": False}


def test_profiles(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in [(1, 1), (1, 2), (2, 3), (None, 4)]], "k long, v double")
    q = {r["share"]: r["value"] for r in P.quantiles(df, "v", shares=(0.0, 0.5, 1.0)).collect()}
    assert q == {0.0: 1.0, 0.5: 2.5, 1.0: 4.0}
    t = {r["at_least"]: (r["n_groups"], r["rows_in_groups"]) for r in P.tail(P.group_sizes(df, "k"), (1, 2, 3)).collect()}
    assert t == {1: (2, 3), 2: (1, 2), 3: (0, 0)}
    empty = df.limit(0)
    assert P.quantiles(empty, "v").where("value is not null").count() == 0 and P.counts(empty, bad=F.col("v") > 1).first()["bad"] == 0
    assert [r["k"] for r in P.top(df, "k", 2).collect()] == [1, None]


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions(spark, data, partitions):
    from platewise.plans.cleaning import cleaning_waterfall, normalise_residue

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sum(r["newly"] for r in cleaning_waterfall(spark, data).collect()) > 0
        assert normalise_residue(spark, data).count() == spark.read.parquet(f"{data}/corpus.parquet").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_large_mappings_are_looked_up_alike(spark):
    from platewise.operators import cleaning as C

    df = spark.createDataFrame([(1, ["Salt ", "x", None]), (2, None), (3, ["SALT"] * 9)], "id long, items array<string>")
    mapping = spark.createDataFrame([("salt", "Sea Salt"), ("y", None), (None, "z")], "raw_ingr string, replaced string")
    want = {1: (["sea salt", "x"], True), 2: ([], False), 3: (["sea salt"] * 9, False)}
    for sent in (500_000, 0):
        assert {r["id"]: (r["norm"], r["has_unmappable"]) for r in C.normalise(df, "id", "items", mapping, sent=sent).collect()} == want

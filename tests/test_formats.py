import json

from platewise.sources import formats as X


def test_round_trips(spark, tmp_path):
    rows = [("a \"b\", c\nd", 1, 2, 3, None, "['x']", "[1]", 1, "['s']", None, "['i']", 1), ("plain", 2, 2, 3, "x", None, None, None, None, "d", None, None)]
    df = spark.createDataFrame(rows, X.RECIPES)
    X.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, X.read_csv(spark, f"{tmp_path}/c", X.RECIPES).collect())) == sorted(rows)
    assert X.read_csv(spark, f"{tmp_path}/c", X.RECIPES, "id", "name").columns == ["id", "name"]
    X.write_json(df, f"{tmp_path}/j")
    assert sorted(map(tuple, X.read_json(spark, f"{tmp_path}/j", X.RECIPES).collect())) == sorted(rows)
    X.write_parquet(df, f"{tmp_path}/p", "minutes")
    assert X.read_parquet(spark, f"{tmp_path}/p", "name", "id").count() == 2


def test_pickled_mapping_and_reports(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"raw_ingr": ["A", "b"], "replaced": ["a", None], "more": [1, 2]}).to_pickle(f"{tmp_path}/m.pkl")
    m = X.read_pickled_mapping(spark, f"{tmp_path}/m.pkl")
    assert sorted((r["raw_ingr"], r["replaced"] or "") for r in m.collect()) == [("A", "a"), ("b", "")]
    assert len(json.loads(X.metrics_json(m))) == 2
    assert X.markdown("t", m).count("\n") == 6
    (tmp_path / "one.json").write_text('{"a":\n 1}')
    assert X.read_json(spark, f"{tmp_path}/one.json", whole_file=True).first()["a"] == 1


def test_pruned_scan_and_pushed_filter(spark, data, capsys):
    spark.read.parquet(f"{data}/interactions.parquet").where("rating >= 4").select("user_id").explain()
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(rating), GreaterThanOrEqual(rating,4)]" in plan and "loaded_at" not in plan

import random

from pyspark.sql import functions as F

from platewise.llm import mixing as M


def test_route_repeats_as_little_as_possible():
    t = {"a": M.Target(0.6, 2), "b": M.Target(0.4, 3)}
    got = M.route({("a",): 100, ("a", "b"): 50, ("b",): 10}, t)
    assert got == {(("a",), "a"): 96, (("a", "b"), "a"): 0, (("a", "b"), "b"): 54, (("b",), "b"): 10}
    assert sum(M.route({("a",): 10}, {"a": M.Target(1.0, 1)}, 100).values()) == 10
    assert M.route({}, t) == {}


def build(spark, seed=1):
    random.seed(seed)
    rows = [(i, random.choices([["a"], ["b"], ["a", "b"], ["c"], ["zzz"], None, []], [60, 8, 5, 3, 5, 1, 1])[0], random.choice([0, 1, 20, 80, 300]), "x") for i in range(2000)]
    targets = {"a": M.Target(0.3, 1), "b": M.Target(0.3, 4), "c": M.Target(0.3, 3), "none": M.Target(0.1, 9)}
    return rows, targets, spark.createDataFrame(rows, "id long, sources array<string>, size long, uses string")


def test_shares_and_caps(spark):
    rows, targets, df = build(spark)
    uses, report = M.mix(df, targets)
    found = [tuple(r) for r in uses.collect()]
    member = {i: set(s or []) & set(targets) for i, s, _, _ in rows}
    sizes = {i: n for i, _, n, _ in rows}
    assert all(s in member[i] and 1 <= u <= targets[s].max_repeats and n == sizes[i] > 0 for i, s, n, u in found)
    assert len({(i, s) for i, s, _, _ in found}) == len(found)
    total = sum(n for i, n in sizes.items() if member[i])
    for r in report.collect():
        t, mine = targets[r["source"]], [(n, u) for i, s, n, u in found if s == r["source"]]
        assert r["actual_tokens"] == sum(n * u for n, u in mine) and r["target_tokens"] == round(t.weight * total)
        most = t.max_repeats * sum(n for i, n in sizes.items() if r["source"] in member[i])
        assert abs(r["actual_tokens"] - min(r["target_tokens"], most)) <= 20
        assert abs(r["actual_share"] - r["actual_tokens"] / total) < 1e-9 and r["most_uses"] <= t.max_repeats
    assert {r["source"] for r in report.collect()} == set(targets)


def test_same_seed_same_mix(spark):
    _, targets, df = build(spark)
    one, two = (sorted(map(tuple, M.mix(d, targets)[0].collect())) for d in (df, df.repartition(7)))
    assert one == two
    assert one != sorted(map(tuple, M.mix(df, targets, seed=5)[0].collect()))


def test_places_are_exact_prefix_sums(spark):
    df = spark.createDataFrame([(i, ["a"], 1 + i % 7) for i in range(500)], "id long, pattern array<string>, size long")
    rows = M._places(df, 3).orderBy("bucket", "h", "id").collect()
    at = 0
    for r in rows:
        assert r["place"] == at
        at += r["size"]


def test_empty_and_dirty_tables(spark):
    _, targets, df = build(spark)
    uses, report = M.mix(df.limit(0), targets)
    assert uses.count() == 0 and report.agg(F.sum("actual_tokens")).first()[0] == 0
    t = M.read_targets(spark.createDataFrame([(" A ", 0.5, None), ("a", None, 3), (None, 0.1, 1), ("", 0.1, 1)], "source string, weight double, max_repeats int"))
    assert t == {"a": M.Target(0.5, 3)}
    assert M.mix(df, {})[1].count() == 0


def test_many_repeats_are_priced_in_blocks():
    t = {"a": M.Target(0.5, 1_000_000), "b": M.Target(0.5, 1)}
    got = M.route({("a",): 3, ("b",): 600_000}, t)
    assert got == {(("a",), "a"): 300_002, (("b",), "b"): 300_002}


def test_overlapping_sources(spark, data):
    from platewise.llm import queries

    report = queries.p7_mix_overlap(spark, data).collect()
    one = {r["source"]: r for r in queries.p7_mix_report(spark, data).collect()}
    assert {r["source"] for r in report} == set(one)
    assert all(r["most_uses"] <= r["max_repeats"] and r["documents"] <= one[r["source"]]["documents"] for r in report)


def test_too_many_patterns_are_refused(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(M, "PATTERNS", 2)
    rows = [(1, ["a"], 5), (2, ["b"], 5), (3, ["a", "b"], 5)]
    with pytest.raises(ValueError):
        M.mix(spark.createDataFrame(rows, "id long, sources array<string>, size long"), {"a": M.Target(0.5, 1), "b": M.Target(0.5, 1)})

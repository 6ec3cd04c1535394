import random
from itertools import combinations

import pytest

from platewise.llm import setjoin as S

random.seed(6)


def make(n=260):
    base = [[f"v{random.randint(0, 80)}" for _ in range(random.randint(1, 14))] for _ in range(n // 4)]
    rows = {}
    for i in range(n):
        x = list(random.choice(base))
        for _ in range(random.randint(0, 2)):
            if x and random.random() < 0.5:
                x.pop(random.randrange(len(x)))
            else:
                x.append(f"v{random.randint(0, 80)}")
        rows[i] = set(x) | ({"hot"} if i % 3 == 0 else set())
    return {i: s for i, s in rows.items() if s}


SETS = make()


def jaccard(sets, least, num=4, den=5):
    big = {i: s for i, s in sets.items() if len(s) >= least}
    return {(a, b) for a, b in combinations(sorted(big), 2) if den * len(big[a] & big[b]) >= num * len(big[a] | big[b])}


@pytest.mark.parametrize("row_cost,block,num,den", [(32, 4096, 4, 5), (0, 2, 4, 5), (0.3, 5, 1, 2)])
def test_equals_brute_force(spark, row_cost, block, num, den):
    df = spark.createDataFrame([(i, v, "x") for i, s in SETS.items() for v in s] + [(1, None, "x"), (None, "v1", "x"), (0, next(iter(SETS[0])), "x")], "id long, val string, rep string")
    members = S.classes(df, "id", "val")
    trace = []
    pairs = S.similar_pairs(members.where("id = rep").select("id", "vals"), num, den, 3, row_cost, block, trace)
    members = members.where("size >= 3")
    got = [tuple(r) for r in S.expand(members, pairs, block).collect()]
    want = jaccard(SETS, 3, num, den)
    assert len(got) == len(set(got)) and set(got) == want
    links = {r["id"]: r["links"] for r in S.link_counts(members, pairs).collect()}
    assert all(links[i] == sum(i in p for p in want) for i in links)
    if not row_cost:
        assert [t["values"] for t in trace[:3]] == [1, 2, 3] and all(t["extended"] for t in trace[:2])


def test_combinations_grow_with_the_data_and_candidates_do_not(spark):
    """Sets of a vocabulary of 80 values, 4 % of them nearly copies: ten times the sets bring longer combinations, not more false candidates."""

    def run(n):
        rng = random.Random(3)
        sets = []
        for i in range(n):
            s = set(rng.sample(range(80), 12)) if not sets or rng.random() > 0.04 else rng.choice(sets) ^ {rng.randrange(80)}
            sets.append(s)
        df = spark.createDataFrame([(i, [f"v{x:02}" for x in sorted(s)]) for i, s in enumerate(sets)], "id long, vals array<string>")
        reps, trace = S.by_content(df).where("id = rep").select("id", "vals"), []
        pairs = S.similar_pairs(reps, row_cost=4, trace=trace).count()
        return trace[:-1], trace[-1]["candidates"] / pairs

    (small, per_pair), (large, per_pair_large) = run(400), run(4000)
    assert len(large) > len(small)
    assert large[0]["extended"] and large[1]["extended"] and large[2]["compared"]
    assert per_pair_large <= per_pair + 0.05


def test_sets_of_arrays(spark):
    rows = [(1, ["b", "a", None, "a"], 0), (1, ["c"], 0), (1, ["c"], 0), (2, ["x"], 0), (3, None, 0), (3, [], 0), (None, ["y"], 0), (None, ["y"], 0), (4, [None], 0)]
    got = {r["id"]: r["vals"] for r in S.records(spark.createDataFrame(rows, "k long, v array<string>, vals int"), "k", "v").collect()}
    assert got == {1: ["a", "b", "c"], 2: ["x"]}


def test_a_third_of_all_rows_are_copies(spark):
    sets = {i: set("abcdef") for i in range(600)} | {i: {f"w{i}", "a", "b"} for i in range(600, 1500)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, vals array<string>")
    members = S.by_content(df)
    pairs = S.similar_pairs(members.where("id = rep").select("id", "vals"))
    assert pairs.count() == 0 and S.expand(members, pairs, 64).count() == 600 * 599 // 2
    assert S.link_counts(members, pairs).where("links = 599 and class_id = 0").count() == 600


def test_a_class_of_many_copies_with_a_partner(spark):
    sets = {i: set("abcdefghij") for i in range(200)} | {i: set("abcdefghijk") for i in range(200, 205)}
    members = S.by_content(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, vals array<string>"))
    pairs = S.similar_pairs(members.where("id = rep").select("id", "vals"))
    got = [tuple(r) for r in S.expand(members, pairs, 16).collect()]
    assert len(got) == len(set(got)) == 205 * 204 // 2


def test_between_two_tables(spark):
    left, right = {i: s for i, s in SETS.items() if i % 2}, {i + 1: s for i, s in SETS.items() if not i % 2}
    l, r = (spark.createDataFrame([(i, sorted(s) * 2) for i, s in t.items()], "id long, vals array<string>") for t in (left, right))
    got = {(x["a"], x["b"]) for x in S.similar_between(l, r, least=3).collect()}
    assert got == {(a, b) for a, s in left.items() for b, t in right.items() if len(s) >= 3 and len(t) >= 3 and 5 * len(s & t) >= 4 * len(s | t)}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, val string")
    members = S.classes(df, "id", "val")
    assert S.similar_pairs(members.select("id", "vals")).count() == 0

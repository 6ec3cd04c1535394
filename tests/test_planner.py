import pytest

from platewise.operators import planner as PL
from platewise.plans import common as C
from platewise.plans.planning import pool
from platewise.runtime import cut


@pytest.fixture(scope="module")
def planned(spark, data):
    profiles = [C.PROFILES[0], C.PROFILES[4]]  # an avoided class; a sodium limit
    p = PL.Planner(cut(pool(spark, data, profiles)), profiles, most_repeats=2)
    p.week(days=2)
    return p


def test_invariants_of_every_dish(planned):
    for s in planned.states.values():
        mains = [r["id"] for r in s.rows if r["role"] == "main"]
        sides = [r["id"] for r in s.rows if r["role"] == "side"]
        assert mains and all(mains.count(i) <= 2 for i in mains) and len(sides) == len(set(sides)) and not set(mains) & set(sides)
        plates = {(r["day"], r["slot"]) for r in s.rows}
        for day, slot in plates:
            dishes = [r for r in s.rows if (r["day"], r["slot"]) == (day, slot)]
            assert sum(r["role"] == "main" for r in dishes) == 1 and len(dishes) <= 3
            if s.profile["max_sodium"]:
                assert sum(r["servings"] * r["sodium_mg"] for r in dishes) <= s.profile["max_sodium"] + 1e-6
        for day in {d for d, _ in plates}:
            assert s.eaten(day)["calories"] <= 1.3 * s.daily["calories"]


def test_no_dish_of_an_avoided_class(spark, planned):
    table = PL.as_table(spark, planned.plan())
    allowed = planned.pool.select("profile_id", "id")
    assert table.join(allowed, ["profile_id", "id"], "left_anti").count() == 0
    assert PL.plates(table).count() == table.select("profile_id", "day", "slot").distinct().count()


def test_an_empty_pool_plans_nothing(planned):
    p = PL.Planner(planned.pool.limit(0), [C.PROFILES[0]])
    assert p.fill(0, "lunch") == set() and p.plan() == []


def test_a_replaced_dinner_keeps_the_rest_and_locked_slots_stay(planned):
    profiles = [C.PROFILES[0], C.PROFILES[4]]
    p = PL.Planner(planned.pool, profiles)
    p.fill(0, "lunch")
    p.fill(0, "dinner")
    lunch, first = ([dict(r) for r in p.plan() if r["slot"] == s] for s in ("lunch", "dinner"))
    p.replace(0, "dinner")
    assert [r for r in p.plan() if r["slot"] == "lunch"] == lunch
    mains = {(r["profile_id"], r["id"]) for r in first if r["role"] == "main"}
    assert mains and not mains & {(r["profile_id"], r["id"]) for r in p.plan() if r["slot"] == "dinner"}
    later = PL.Planner(planned.pool, profiles, locked=lunch)
    later.week(1)
    held = {r["profile_id"] for r in lunch}
    assert held and [r for r in later.plan() if r["slot"] == "lunch" and r["profile_id"] in held] == lunch and len({r["slot"] for r in later.plan()}) == 3

from platewise.plans import common, planning


def test_plan_week_has_every_profile(spark, data):
    rows = planning.plan_week(spark, data).select("profile_id", "day").distinct().collect()
    assert {tuple(r) for r in rows} == {(p["profile_id"], d) for p in common.PROFILES for d in range(7)}

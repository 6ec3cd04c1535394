from oracle import compare, connect

from platewise.llm import queries


def test_lift_all_has_rare_pairs(spark, data):
    floor = "WHERE n_ab >= 5 AND 1000 * n_ab >= (SELECT count(*) FROM rows_)"
    assert queries.SQL["p1_lift"].count(floor) == 1
    compare(connect(data), queries.QUERIES["p1_lift_all"](spark, data), queries.SQL["p1_lift"].replace(floor, ""))

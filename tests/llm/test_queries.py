import pytest
from oracle import compare, connect

from platewise.llm import queries


def test_every_sql_belongs_to_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, data, name):
    compare(connect(data), queries.QUERIES[name](spark, data), queries.SQL[name])


def test_tag_pairs_equal_brute_force(spark, data):
    from platewise.operators.packed import PHRASES, explode_packed

    sets = {}
    for r in explode_packed(spark.read.parquet(f"{data}/recipes.parquet"), "id", {"tags": PHRASES}).collect():
        sets.setdefault(r["id"], set()).add(r["val"])
    big = sorted(i for i, s in sets.items() if len(s) >= 6)
    want = {(a, b) for a in big for b in big if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in queries.p3_tag_pairs(spark, data).collect()} == want


def test_found_columns(spark, data):
    want = {
        "p1_found": ["item_a", "item_b"], "p3_found": ["field", "id_a", "id_b"], "p5_found": ["id", "pos", "replaced"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "kind"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, data).columns == columns

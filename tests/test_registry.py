import re
from pathlib import Path

import pytest
from oracle import compare, connect

from platewise.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_optional_subpackage():
    for path in (ROOT / "platewise").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "platewise").parts:
            assert not re.search(r"(from|import)\s+platewise\.llm", path.read_text()), path


def test_every_sql_belongs_to_a_query():
    assert set(registry.sql()) <= set(registry.queries())


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_query_equals_its_sql(spark, data, name):
    con = connect(data)
    compare(con, registry.queries()[name](spark, data), registry.sql()[name])

"""Every registered query next to its SQL on the smallest tables."""
import pytest

import __spark_entry__ as entry
from compare import check, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, small, name):
    rows, diff = check(spark, con, name, entry.queries()[name], SQL.get(name), small)
    assert not diff, diff
    assert rows >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_row_by_row_python(spark, small):
    """Plans of the hot path stay in the JVM."""
    for name in ("d_registry_hits", "f5_e9_text_names", "c5_sentences", "f29_pair_lift"):
        plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "NestedLoop" not in plan

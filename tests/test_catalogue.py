import pytest
from helpers import rows_of, sql_rows

from panelforge.functions import constants as C
from panelforge.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, data, name):
    assert rows_of(catalogue.QUERIES[name](spark, data)) == sql_rows(duck, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    """Fitted models: their values are tested against brute force beside their operators."""
    rows = [r for r in catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").collect() if "code" not in r or r["code"] != C.NOT_OBSERVED]
    assert rows and not any(r[c] is None or r[c] != r[c] for r in rows for c in ("mu", "sigma", "alpha", "b1") if c in r)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

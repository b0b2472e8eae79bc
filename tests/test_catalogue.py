"""Every registered query against its DuckDB twin."""

import pytest
from conftest import check_oracle

from palimpsest.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(name, spark, sf_dir, duck):
    check_oracle(catalogue.QUERIES[name](spark, sf_dir), duck, catalogue.ORACLES[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())

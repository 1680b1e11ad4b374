"""Every query with SQL gives the SQL's rows; every other query runs."""

import pytest

from odweave.plans import catalog
from tests.conftest import SF, plain

Q, S = catalog.queries(), catalog.oracle_sql()
#: Queries with many model fits: their operators are tested on small tables (test_models), the whole query by the driver's run.
SLOW = {"rf_cv", "gbt_cv", "held_out_comparison", "e8_tree_models", "permutation_importance", "shape_summary"}


@pytest.mark.parametrize("name", sorted(S))
def test_same_rows_as_sql(spark, duck, name):
    got = Q[name](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    want = duck.execute(S[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert plain(rows, cols) == plain(want.astype(object).to_dict("records"), cols)


@pytest.mark.parametrize("name", sorted(set(Q) - set(S) - SLOW))
def test_runs(spark, name):
    assert Q[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

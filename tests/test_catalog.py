"""Every query of the catalog against its SQL, on the smallest tables."""

import os

import oracle
import pytest

from stowage.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        oracle.same(df, tables, catalog.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = catalog.entry(spark, SF).collect()
    assert sum(r.objects for r in rows) == 200


def test_page_is_a_top_k(spark):
    plan = catalog.QUERIES["k1_list_page"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan

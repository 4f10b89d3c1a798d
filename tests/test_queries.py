import os

import pytest

import __spark_entry__ as entry
from compare import compare, database
from plateview.plans.catalog import QUERIES
from plateview.plans.check_sql import CHECKS

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)
    assert set(QUERIES) - set(CHECKS) == {"logreg_report", "logreg_sweep"}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, db, name):
    assert compare(spark, db, QUERIES[name], CHECKS[name], FOLDER) == ""


def test_entry_has_rows(spark):
    table = entry.entry(spark)
    assert table.columns == ["review_id", "aspect", "label", "confidence", "n_evidence"] and table.count() > 0

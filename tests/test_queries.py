"""The registered queries against their SQL, on the smallest sample."""

from pathlib import Path

import pytest

FOLDER = Path("/root/testdata/sf0.001")
pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="sample tables are not here")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_oracles import compare, connect  # noqa: E402
from tenderloom.plans.catalog import CATALOG  # noqa: E402


@pytest.fixture(scope="module")
def db():
    return connect(str(FOLDER))


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_agrees_with_sql(spark, db, name):
    df = queries()[name](spark, str(FOLDER))
    result = db.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert compare(df.collect(), df.columns, result.fetchall(), columns) is None


def test_every_query_has_sql():
    assert set(CATALOG) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).schema.names[0] == "match_id"

"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from quillstream.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(names, tuples):
    """Column names in order, and the rows as sorted text; a null is '', in whatever type the engine returns it."""
    order = sorted(range(len(names)), key=names.__getitem__)
    shown = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, (float, Decimal)) else str(v)
    return sorted(names), sorted(tuple(shown(r[i]) for i in order) for r in tuples)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_equals_sql(spark, duck, sf_dir, name):
    ours, theirs = registry.queries()[name](spark, sf_dir), duck.sql(registry.oracle_sql()[name])
    assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())

"""Each query against its SQL, run by another engine on the same tables."""

import glob
import math
import os
from datetime import datetime, timezone
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest

from barloom.plans import data_queries, dataset_queries, reference_queries

MODULES = (data_queries, reference_queries, dataset_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    """A value for comparison: integers, texts and times exactly, doubles to nine significant digits."""
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime):
        return round((v if v.tzinfo else v.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000)
    if isinstance(v, Decimal):
        return int(v) if v == int(v) else float(v)
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows(table, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, data, name):
    got = QUERIES[name](spark, data)
    want = pa.table(duck.sql(ORACLES[name]).to_arrow_table())
    columns = sorted(got.columns)
    assert columns == sorted(want.column_names)
    assert rows(got.toArrow(), columns) == rows(want, columns)


#: Queries that SQL can't state, with a least number of rows at the smallest scale; each has tests of its own against brute force.
WITHOUT_SQL = {"p1_found": 300, "p1_formats": 5, "p3_found": 20, "p4_found": 1, "p4_records": 200, "p5_profile": 5, "ref_m15_policy_hook": 50, "ref_s5_klines_to_ohlcv": 50, "ref_x6_digest": 1}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql(spark, data, name):
    got = QUERIES[name](spark, data)
    out = got.toArrow()
    assert out.num_rows >= WITHOUT_SQL[name] and all(out[c].null_count < out.num_rows for c in out.column_names if c not in ("new_field",))


def test_entry_has_every_name(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 50


def test_core_goes_on_without_the_llm_package(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "barloom.llm.queries", None)  # its import raises, as with a missing library
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)

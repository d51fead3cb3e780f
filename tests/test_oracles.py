"""Every query with SQL gives what DuckDB gives."""

import importlib
import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from rivulet import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [normal(v) for v in value]
    return str(value)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    wrong = {c: (t, types[c]) for c, t in got.dtypes if t in KINDS and KINDS[t] != types[c]}
    assert not wrong
    want = Counter(str([normal(v) for v in r]) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall())
    have = Counter(str([normal(v) for v in r]) for r in got.select(*columns).collect())
    assert sum(want.values()) > 0
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])


def test_rows_only(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, SF).columns


def test_entry_imports():
    assert importlib.import_module("__spark_entry__").queries()

"""Every query with an oracle against DuckDB, on the smallest tables."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from zonalis import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.8g}")
    return tuple(map(cell, x)) if isinstance(x, list) else x


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    rows = sorted((tuple(cell(r[c]) for c in names) for r in df.collect()), key=str)
    if name in catalog.ORACLE_SQL:
        want = db.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == names
        at = [want.columns.index(c) for c in names]
        assert rows == sorted((tuple(cell(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_the_rest_does_not_import_the_training_data_part():
    code = "import sys; sys.modules['zonalis.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(k.startswith('op') for k in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr

"""Every event query against its SQL on the smallest tables."""

import decimal

import duckdb
import numpy as np
import pytest

from eventlens import feed_queries, queries, state_queries, stream_queries  # noqa: F401  they register their queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, list | np.ndarray):
        return [plain(x) for x in v]
    if isinstance(v, int | float | decimal.Decimal) and not isinstance(v, bool):
        return round(float(v), 9)
    return v


def rows(found):
    return sorted(repr(tuple(plain(v) for v in r)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = queries.ORACLE_SQL[name]
    want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall()
    assert sorted(duck.sql(sql).columns) == columns
    assert rows(map(tuple, df.select(*columns).collect())) == rows(want)


def test_entry_imports_without_the_llm_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/eventlens", tmp_path / "eventlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from corvane import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(rows):
    return sorted([tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, sf_dir, db, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    if name not in catalogue.ORACLES:
        assert got
        return
    result = db.execute(catalogue.ORACLES[name])
    named = [d[0] for d in result.description]
    want = [tuple(dict(zip(named, r))[c] for c in columns) for r in result.fetchall()]
    assert sorted(named) == columns and plain(got) == plain(want)


def test_entry_works_without_the_toolkit(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "corvane"):
        source = os.path.join(here, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "corvane/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q if n != 'org_profile')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code.replace("n.startswith('op')", "n[:2] == 'op' and n[2].isdigit()")], cwd=tmp_path, env=env, check=True)


def test_filters_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["volume_countif"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(source,src1)" in plan and "ReadSchema: struct<text:string,source:string>" in plan

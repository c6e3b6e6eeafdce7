"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest
from claimlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROWS = {"html_blocks": 100, "legal_chunks": 100, "sentence_spans": 100, "topology_hash": 1, "merkle_root": 1, "inherited_approx_distinct": 1}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def shape(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(shape, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(shape(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert len(got) >= ROWS[name]
        return
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(shape(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert got == want and got


def test_library_stands_without_the_pipeline(tmp_path):
    """In a copy without the subpackage, its tests and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(catalog.__file__).parents[2]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(o) <= set(q) and not any(k.startswith('op') for k in q)"
    modules = [".".join(p.relative_to(copy).with_suffix("").parts) for p in (copy / "claimlake").rglob("*.py") if p.stem not in ("__init__", "__main__")]
    subprocess.run([sys.executable, "-c", f"{code}; import importlib; [importlib.import_module(m) for m in {modules}]"], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(catalog.filtered_union(spark, sf))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in plan.replace(",ts:timestamp_ntz", "")
    assert "Python" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["provenance_chain", "nl_contradictions", "xref_join", "diff_all", "line_spans"])
def test_hot_queries_stay_in_the_engine(name, spark, sf):
    plan = plan_of(catalog.QUERIES[name](spark, sf))
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan

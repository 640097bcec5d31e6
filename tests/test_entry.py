import importlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["sql_type_rank_compare", "sql_concat_double", "ts_agg_avg_null_denominator", "ts_retention_ttl", "doc_mixed_kinds", "graph_bfs_levels", "ts_retention_both", "graph_traverse_limit", "dml_update_sequential", "validate_row_errors", "codec_rows_json"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "part", "events", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF).select(*columns)
    norm = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert norm(map(tuple, got.collect())) == norm(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_the_surface_against_sql(spark):
    from tessella.plans import surface

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, (query, sql) in surface.entries().items():
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        got = query(spark, SF)
        assert sorted(got.columns) == sorted(columns), name
        norm = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
        assert norm(map(tuple, got.select(*columns).collect())) == norm(want.fetchall()), name


def test_without_the_subpackage(tmp_path):
    """The rest imports, and has its queries, where the subpackage and the pipeline are gone."""
    shutil.copytree(f"{ROOT}/tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, sys; q = e.queries(); assert 'sql_time_bucket' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql(); assert not any('llm' in m for m in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_the_subpackage():
    for base, _, names in os.walk(f"{ROOT}/tessella"):
        if "llm" not in base:
            for n in names:
                if n.endswith(".py"):
                    assert "tessella.llm" not in open(f"{base}/{n}").read()
    assert importlib.import_module("tessella").__version__

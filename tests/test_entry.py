"""The registry works, with the training-data operators or without them."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.oracle_sql()) >= 60


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_entry_imports_without_the_subpackage(tmp_path):
    for name in ("mosaiq", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/mosaiq/llm"], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()))"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert "markers_rank_sum" in out.stdout and "op2_" not in out.stdout and "pipeline" not in out.stdout


NAMES = ["filter_grid", "reduce_resolution", "adjust_counts", "zscale", "knn_points", "hex_grid", "box_smooth", "layer_peel", "isolate_components", "territory_borders", "bubble_centers", "markers_rank_sum", "markers_welch", "markers_wilcox", "markers_chisq", "markers_ttest_p", "markers_fisher_p", "markers_wilcox_exact", "tmm_factors", "size_factors", "equalize_piecewise", "equalize_plateau", "smooth_median", "smooth_iso", "total_cost_sparse", "holm_adjust", "composition_jaccard", "filter_cost", "dedupe_map", "cost_contribution"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_duckdb(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    norm = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(e.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(float(x[i]) if type(x[i]).__name__ == "Decimal" else x[i]) for i in at) for x in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == cols
    assert got == want

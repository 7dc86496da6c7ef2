"""Plan checks: what must not appear in the physical plans."""

from __future__ import annotations

import os
import pathlib
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
# Queries whose core is a task-local numpy kernel over pairs of blocks.
PAIRWISE = {"knn_self_join", "knn_distance", "density_clusters", "silhouette"}
SAMPLE = ("star_extract", "ts_feature_table", "sku_feature_table", "xt_sum", "xt_median", "iqr_cap", "forecast_merge",
          "seasonal_naive", "exp_smoothing_fc", "calendar_complete", "year_correlation", "history_refresh")


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in text, word


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["level_filter"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(p_brand,Brand#7\)", text)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(n_name,NATION_3\)", text)
    assert "l_tax" not in text and "l_shipdate" not in text and "p_retailprice" not in text


@pytest.mark.parametrize("name", ["star_extract", "extract_count", "relative_month_range", "last_36_months", "training_cutoff"])
def test_month_windows_reach_the_scan_of_orders(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", text)


def test_a_clicked_key_reaches_the_scan(spark):
    text = plan(entry.queries()["row_click_filter"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_partkey,42\)", text)


def test_a_query_runs_from_another_folder(tmp_path):
    """Workers get the package from the session, not from the working folder."""
    script = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from tallyline.session import build_session\n"
        "spark = build_session('other', 'local[2]', 2, {'spark.checkpoint.dir': sys.argv[2]})\n"
        "from tallyline.operators.pairwise import knn_distance\n"
        "points = spark.createDataFrame([(str(i), [float(i), 0.0]) for i in range(30)], 'id string, vector array<double>')\n"
        "print('rows', knn_distance(points, 2).count())\n")
    root = pathlib.Path(__file__).parent.parent
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script, str(root), str(tmp_path / "shared")], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert "rows 30" in done.stdout, done.stderr[-2000:]


def test_features_shuffle_a_series_once_after_the_roll_up(spark):
    from tallyline.operators.features import ts_features
    from tallyline.sources.tables import Tables, long_series

    text = plan(ts_features(long_series(Tables(spark, FOLDER), ["catalog_number"])))
    # One exchange for the monthly roll-up, one to bring a series together; joins broadcast here.
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2


def test_no_hints_no_local_checkpoint_no_bare_correlation():
    root = pathlib.Path(__file__).parent.parent / "tallyline"
    for path in root.rglob("*.py"):
        text = path.read_text()
        for word in ("localCheckpoint(", "F.broadcast(", "crossJoin(", "F.corr(", ".rdd", "toPandas("):
            assert word not in text, (path.name, word)


def test_checkpoint_folder_comes_from_the_session(spark):
    from tallyline.lineage import checkpoint_root, scratch_path

    named = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_root(spark) == named
    assert scratch_path(spark, "x").startswith(named)

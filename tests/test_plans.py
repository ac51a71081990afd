"""Plan checks: column pruning and filter pushdown reach the parquet scans;
order statistics do not run as one-task windows."""

import re

import __spark_entry__ as E
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_scan_is_pruned(spark):
    plan = _plan(E.queries()["flagship_run_report"](spark, SF001))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    li = [s for s in scans if "l_orderkey" in s]
    assert li, plan
    for col in ("l_partkey", "l_quantity", "l_tax", "l_linestatus", "l_shipdate"):
        assert all(col not in s for s in li)


def test_filter_reaches_scan_through_spread(spark):
    df = E.queries()["jn22_draw_with_replacement"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan.replace(" ", "")


def test_no_unpartitioned_window_over_data(spark):
    # the bucketed numbering only windows over (bucket[, key]); the sole
    # unpartitioned window runs over the small per-bucket offsets table
    plan = _plan(E.queries()["wn20_kfold"](spark, SF001))
    windows = re.findall(r"Window \[[^\]]*\], \[([^\]]*)\]", plan)
    assert any("_bucket" in w for w in windows)

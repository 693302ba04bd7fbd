"""The plans are the ones meant: shuffle counts, pruned scans, no one-task windows over data."""

import pytest
from pyspark.sql import functions as F

from gridspark import adapters as A
from gridspark.operators import kernels as K, regrid as G, requests as R
from gridspark.workload import load

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning") + plan(df).count("Exchange SinglePartition")


def test_block_kernels_use_one_shuffle(spark):
    cells = A.cells(spark, FOLDER)
    assert shuffles(K.fill_holes(cells, "v", 4, A.H, A.W)) == 1
    assert shuffles(K.max_filter(cells, {"a": ("v", 9), "b": ("v", 17)}, A.H, A.W)) == 1
    assert shuffles(K.slope_normals(cells, "v", A.H, A.W)) == 1
    assert shuffles(K.min_corners(cells, ["v"], 3, A.H, A.W)) == 1


def test_wide_blurs_use_one_shuffle_per_axis(spark):
    assert shuffles(K.gaussian(A.cells(spark, FOLDER), "v", 28.0, A.H, A.W)) == 2


@pytest.mark.parametrize("kernel", ["box", "lanczos"])
def test_resampling_uses_one_shuffle_per_axis(spark, kernel):
    df = G.resize(A.cells(spark, FOLDER), ["v"], (A.H, A.W), (96, 128), kernel)
    assert shuffles(df) == 2 and "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_top_requests_do_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(R.top_requests(A.requests(spark, FOLDER), 16))


def test_scans_are_pruned_and_filtered(spark):
    text = plan(A.elements(spark, FOLDER))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in text and "props" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["c1_latest_complete_cycle", "c2_asof_elements", "c10_nearest_satellite", "c14_parent_fallback", "c18_nearest_month",
                                  "d11_scene_summary", "d22_area_quantiles", "k3_seam_balance", "k5_storm_steering", "e12_slow_runs"])
def test_no_pairwise_joins_and_no_one_task_windows(spark, name):
    text = plan(load()[name].run(spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Exchange SinglePartition" not in text

"""The registry: it loads without a session, every query runs, and SQL agrees on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, key
from gridspark.workload import load

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["a1_message_ranges", "a7_element_sets", "b12_index_rules", "c2_asof_elements", "c4_axis_index", "c9_seam_correction", "d2_full_pyramid",
          "d18_metered_key", "e2_polar_lowpass", "f2_service_order", "g3_obsolete_generations", "g4_eviction_plan", "h12_tile_algebra",
          "k0_cloudy_share_per_hour", "k5_storm_steering", "i11_throttled_refreshes"]


def test_registry_loads_without_a_session():
    root = Path(__file__).resolve().parents[1]
    code = ("import __spark_entry__ as e, gridspark.workload as w; own = set(w.load()); "
            "print(len(own), len(own & set(e.queries())), len(own & set(e.oracle_sql())))")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    own, queries, oracles = map(int, out.stdout.split())
    assert own == queries == oracles


def test_every_query_has_sql():
    assert not {n for n, e in load().items() if e.sql is None}


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and df.columns == ["run_us", "by", "bx", "n", "share", "mean_cloud"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, con, name):
    e = load()[name]
    df = e.run(spark, FOLDER)
    cols = sorted(df.columns)
    rel = con.sql(e.sql)
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert sorted(key(r) for r in df.select(*cols).collect()) == sorted(key([r[i] for i in order]) for r in rel.fetchall())

"""Queries over rasters against their SQL where the last grid lacks cells."""

import duckdb
import pytest

from gridspark.workload import load

QUERIES = """c3_regrid_bilinear c6_nodes_to_centres c11_area_overlap d4_resize_lanczos d4_resize_bicubic e2_polar_lowpass
  e15_bspline_upsampled k2_cloud_cover k2_cover_with_gaps_in_the_model k10_day_pyramid k11_relief_pyramid k12_retiled_layers""".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One grid of 256 of its 500 tiles: the lower part is absent, and of one row of tiles the greater part."""
    d = str(tmp_path_factory.mktemp("partial"))
    spark.range(256).selectExpr("id as vec_id", """transform(sequence(0, 63), i -> cast(
        ((id * 37 + i * 11) % 101 - 50) / 100e0 as float)) as embedding""", "0 as label").coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", QUERIES)
def test_absent_cells_as_in_sql(spark, folder, name):
    entry = load()[name]
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    got = entry.run(spark, folder)
    want = con.sql(entry.sql)
    at = [want.columns.index(c) for c in got.columns]
    rows = lambda all_rows: sorted(all_rows, key=repr)
    assert rows(tuple(r) for r in got.collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())

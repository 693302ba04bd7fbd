"""Kernels on grids with absent cells, narrow last blocks and wide radii, against brute force over coordinates."""

import random
import time

import pytest

from gridspark.operators import kernels as K

CELLS = "grid_id int, y int, x int, v double"


def sparse(draw, height, width, absent=0.05, missing=0.05, grids=(0, 7)):
    return {(g, y, x): None if draw.random() < missing else float(draw.randrange(1000))
            for g in grids for y in range(height) for x in range(width) if draw.random() >= absent}


def frame(spark, cells):
    return spark.createDataFrame([(*k, v) for k, v in cells.items()], CELLS)


def result(df, column="v"):
    return {(r.grid_id, r.y, r.x): r[column] for r in df.collect()}


# Widths that leave a last block of 1, 3 and 8 columns; radii up to the block.
@pytest.mark.parametrize("height,width,block,radius", [(9, 17, 8, 1), (17, 19, 8, 5), (12, 24, 8, 8), (21, 33, 16, 16)])
def test_max_filter_and_corners_by_coordinate(spark, height, width, block, radius):
    draw = random.Random(width)
    cells = sparse(draw, height, width)
    df = frame(spark, cells)
    got = result(K.max_filter(df, {"m": ("v", 2 * radius + 1)}, height, width, block), "m")
    span = range(-radius, radius + 1)

    def best(values, pick):
        values = [v for v in values if v is not None]
        return pick(values) if values else None

    assert got == {(g, y, x): best([cells.get((g, y + a, x + b)) for a in span for b in span], max) for g, y, x in cells}
    got = result(K.min_corners(df, ["v"], radius, height, width, block))
    rows = lambda y: (max(0, y - radius), min(height - 1, y + radius))
    assert got == {(g, y, x): best([cells.get((g, r, (x + c) % width)) for r in rows(y) for c in (-radius, radius)], min)
                   for g, y, x in cells}


@pytest.mark.parametrize("width,block", [(17, 8), (20, 16)])
def test_holes_grow_by_coordinate(spark, width, block):
    cells = sparse(random.Random(width), 11, width, absent=0.1, missing=0.4)
    want = dict(cells)
    for _ in range(4):
        before = dict(want)
        for (g, y, x), v in before.items():
            near = [before.get(k) for k in ((g, y - 1, x), (g, y + 1, x), (g, y, x - 1), (g, y, x + 1))]
            near = [n for n in near if n is not None]
            if v is None and near:
                want[g, y, x] = sum(near) / len(near)
    got = result(K.fill_holes(frame(spark, cells), "v", 4, 11, width, block))
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v or 0.0, 9) for k, v in want.items()}


def test_normals_know_absent_neighbours(spark):
    cells = sparse(random.Random(4), 9, 17, missing=0.0)
    got = {(r.grid_id, r.y, r.x): r for r in K.slope_normals(frame(spark, cells), "v", 9, 17, block=8).collect()}
    for (g, y, x), v in cells.items():
        east, west = cells.get((g, y, (x + 1) % 17)), cells.get((g, y, (x - 1) % 17))
        r = got[g, y, x]
        if east is None or west is None:
            assert r.nx is None
        elif (g, y - 1, x) in cells and (g, y + 1, x) in cells:
            dx, dy = (east - west) * 0.4, (cells[g, y + 1, x] - cells[g, y - 1, x]) / 2 * 0.8
            assert r.nx == pytest.approx(-dx / (dx * dx + dy * dy + 1) ** 0.5)


def lowpass(cells, height, width):
    import math
    out = {}
    for (g, y, x), v in cells.items():
        wide = 1.0 / max(math.cos(math.radians(90.0 - (y + 0.5) * 180.0 / height)), 1e-6)
        k = round(min(wide, width / 2))
        box = [cells.get((g, y, (x - k // 2 + i) % width)) for i in range(k)]
        box = [b for b in box if b is not None]
        out[g, y, x] = v if k < 2 else sum(box) / len(box) if box else None
    return out


@pytest.mark.parametrize("height,width", [(40, 16), (61, 33)])
def test_polar_lowpass_by_coordinate(spark, height, width):
    cells = sparse(random.Random(height), height, width, absent=0.1, missing=0.2)
    got = result(K.polar_lowpass(frame(spark, cells), ["v"], height, width))
    want = lowpass(cells, height, width)
    assert got.keys() == want.keys()
    assert all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())


def test_polar_lowpass_is_linear_in_the_width(spark):
    def seconds(width):
        row = spark.range(width).selectExpr("0 as grid_id", "0 as y", "cast(id as int) as x", "cast(id % 97 as double) as v")
        start = time.perf_counter()
        K.polar_lowpass(row, ["v"], 100_000, width).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(1000)
    assert min(seconds(160_000) for _ in range(2)) < 2.0 * min(seconds(80_000) for _ in range(2)) + 1.0

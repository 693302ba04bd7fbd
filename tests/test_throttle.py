"""Attempts behind a minimum gap, against a plain walk, with a million attempts on one key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.operators import throttle


def walk(times, gap):
    made, last = [], None
    for t in times:
        if last is None or t - last >= gap:
            made.append(t)
            last = t
    return made


@pytest.mark.parametrize("width", [None, 50.0])
def test_attempts_made_start_the_wait(spark, width):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(2000) < 0.7, 0, rng.integers(1, 6, 2000)), "t": rng.integers(0, 3000, 2000), "i": rng.permutation(2000)})
    out = throttle.throttled(spark.createDataFrame(pdf), ["k"], "t", ["i"], 7, width).toPandas()
    for k, part in pdf.groupby("k"):
        first = part.groupby("t")["i"].min()
        assert sorted(out[out["k"] == k]["t"]) == walk(sorted(part["t"]), 7)
        assert all(first[t] == i for t, i in out[out["k"] == k][["t", "i"]].itertuples(index=False))


def test_steady_polling_does_not_starve(spark):
    df = spark.createDataFrame([("a", t, t) for t in range(0, 100, 3)] + [("b", 5, 1), ("b", 5, 0), ("b", None, 2)], "k string, t long, i long")
    out = throttle.throttled(df, ["k"], "t", ["i"], 10).collect()
    assert sorted((r.k, r.t, r.i) for r in out) == [("a", t, t) for t in walk(range(0, 100, 3), 10)] + [("b", 5, 0)]
    assert throttle.throttled(df.where("i < 0"), ["k"], "t", ["i"], 10).count() == 0
    with pytest.raises(ValueError):
        throttle.throttled(df, ["k"], "t", ["i"], 0)


def test_a_million_attempts_on_one_key(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(0).alias("k"), (F.col("id") * 7 + F.col("id") % 5).alias("t"), "id").repartition(8)
    out = throttle.throttled(df, ["k"], "t", ["id"], 100).select("t").toPandas()["t"].sort_values().tolist()
    assert out == walk([i * 7 + i % 5 for i in range(n)], 100)

"""Orbit tracks: velocity, interpolation, refresh throttling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip
from .ordered import neighbour


def velocity(track: DataFrame, by: list[str], time: str, position: str, chunk_width: float,
             radius_km: float = 6371.0) -> DataFrame:
    """Speed in km/s by the central difference of the neighbours of each point; ends have none."""
    a = neighbour(track, by, [time], chunk_width, {"_t0": F.col(time), "_p0": F.col(position)}, offset=-1)
    b = neighbour(a, by, [time], chunk_width, {"_t1": F.col(time), "_p1": F.col(position)})
    inner = b.where(F.col("_t0").isNotNull() & F.col("_t1").isNotNull())
    gone = [F.pow(F.col("_p1")[i] - F.col("_p0")[i], F.lit(2.0)) for i in range(3)]
    seconds = (F.col("_t1") - F.col("_t0")) / 1e6
    return inner.withColumn("speed", F.sqrt(gone[0] + gone[1] + gone[2]) * radius_km / seconds).drop("_t0", "_t1", "_p0", "_p1")


def slerp(df: DataFrame, a: str, b: str, t: Column, out: str) -> DataFrame:
    """Add the unit vector a share ``t`` along the great arc from ``a`` to ``b``; near ends are blended linearly."""
    p, q = F.col(a), F.col(b)
    df = df.withColumn("_c", clip(sum((p[i] * q[i] for i in (1, 2)), p[0] * q[0]), -1.0, 1.0))
    df = df.withColumns({"_angle": F.acos("_c"), "_t": t})
    near = F.col("_c") > 0.9995
    df = df.withColumns({
        "_wa": F.when(near, 1.0 - F.col("_t")).otherwise(F.sin((1.0 - F.col("_t")) * F.col("_angle")) / F.sin("_angle")),
        "_wb": F.when(near, F.col("_t")).otherwise(F.sin(F.col("_t") * F.col("_angle")) / F.sin("_angle"))})
    df = df.withColumns({f"_m{i}": F.col("_wa") * p[i] + F.col("_wb") * q[i] for i in range(3)})
    size = F.sqrt(sum((F.col(f"_m{i}") * F.col(f"_m{i}") for i in (1, 2)), F.col("_m0") * F.col("_m0")))
    df = df.withColumn("_size", size)
    df = df.withColumn(out, F.array(*[F.col(f"_m{i}") / F.col("_size") for i in range(3)]))
    return df.drop("_c", "_angle", "_t", "_wa", "_wb", "_m0", "_m1", "_m2", "_size")

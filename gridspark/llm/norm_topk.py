"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are put in order of length and cut into buckets of similar length. For a query q with a k-th best score s so
far, a vector of a bucket with longest length L can only help if its cosine with q is at least t = s / (|q| L), the
local threshold. Above 1 the whole bucket is passed over. For a low t the bucket is cut where vectors get too short
(|p| < s / |q|); for a high t only vectors whose coordinates lie in the ranges that cosine t allows around the largest
coordinates of q remain. Integer products of the remaining vectors decide, so nothing is lost.

A first pass shows every block of queries the longest bucket alone and so finds a floor under each query's k-th score.
In the second pass a bucket is sent only to blocks whose floors its length can still reach, and the floors go along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import shared_table

BUCKET_ROWS = 2048
QUERY_ROWS = 256
# Buckets and query blocks that one cell of the grid of pairs holds.
CELL_BUCKETS, CELL_BLOCKS = 8, 4
FOCUS = 4  # coordinates that are tested
HIGH = 0.35  # local cosine from which coordinates are tested
SLACK = 1e-9  # for rounding in lengths and cosines
BANDS = 8  # bands of length for each doubling
NO_LENGTH = -100_000  # the band of length zero, below all others


def integers(values, scale: float):
    """The integer vector of a column of floats: floor(scale * x); NULL if NULL or a component is NULL or not finite."""
    wide = values.cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * scale).cast("bigint")))


def _packs(rows: DataFrame, size: int) -> DataFrame:
    """(dim, pack, longest, ids, matrix) of rows (id, v, dim, norm2) already in order of length, at most ``size`` each."""

    def run(batches):
        kept: list[pa.RecordBatch] = []

        def cut(final):
            nonlocal kept
            table = pa.Table.from_batches(kept)
            dims = table["dim"].to_numpy()
            ends = np.flatnonzero(np.diff(dims)) + 1
            starts, stops = [0, *ends], [*ends, len(dims)]
            for a, b in zip(starts, stops):
                last = b == len(dims)
                while b - a >= size or (b > a and (final or not last)):
                    n = min(size, b - a)
                    part = table.slice(a, n)
                    ids = part["id"].to_numpy()
                    matrix = part["v"].combine_chunks().flatten().to_numpy().reshape(n, int(dims[a]))
                    fresh = np.ones(n, bool)  # repeated rows are neighbours in this order
                    fresh[1:] = (np.diff(ids) != 0) | (matrix[1:] != matrix[:-1]).any(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dims[a])], pa.int32()), pa.array([float(part["norm2"][0].as_py())]),
                         pa.array([ids[fresh].tobytes()], pa.binary()), pa.array([matrix[fresh].tobytes()], pa.binary())],
                        names=["dim", "norm2", "ids", "matrix"])
                    a += n
            kept = table.slice(a).to_batches() if a < len(dims) else []

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= 4 * size:
                yield from cut(False)
        if kept:
            yield from cut(True)

    made = rows.mapInArrow(run, "dim int, norm2 double, ids binary, matrix binary")
    return made.withColumn("pack", F.monotonically_increasing_id())


def _merge(ids, scores, new_ids, new_scores, k):
    ids, scores = np.concatenate([ids, new_ids]), np.concatenate([scores, new_scores])
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


class Retrieval:
    """The running best of one block of queries, over buckets in falling length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.floor = np.full(len(ids), -np.inf) if floors is None else floors
        self.exact = queries.astype(np.float64)
        self.norms = np.sqrt((self.exact ** 2).sum(1))
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def bucket(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        exact = vectors.astype(np.float64)
        norms = np.sqrt((exact ** 2).sum(1))
        longest = norms.max()
        directions = exact / np.maximum(norms, 1e-300)[:, None]
        # Sums below 2**53 are exact in doubles; otherwise integers multiply.
        dims = vectors.shape[1]
        small = float(np.abs(self.queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(dims, 1) < 2.0 ** 53
        for i, (query, norm) in enumerate(zip(self.exact, self.norms)):
            known_ids, known = self.best[i]
            at = slice(None)
            least = max(self.floor[i], float(known[-1]) if len(known) == self.k else -np.inf)
            if least > -np.inf and norm * longest > 0:
                t = least / (norm * longest)
                if t > 1 + SLACK:
                    continue
                if t >= HIGH:
                    focus = np.argsort(-np.abs(query))[:FOCUS]
                    unit = query[focus] / norm
                    near = min(t, 1.0)
                    spread = np.sqrt(np.maximum(0, (1 - unit ** 2) * (1 - near ** 2))) + SLACK
                    low = np.where(unit < -near, -2.0, unit * near - spread)
                    high = np.where(unit > near, 2.0, unit * near + spread)
                    part = directions[:, focus]
                    at = np.flatnonzero(((part >= low) & (part <= high)).all(1))
                elif least > 0:
                    at = np.flatnonzero(norms >= least / norm * (1 - SLACK))
                if not isinstance(at, slice) and not len(at):
                    continue
            scores = (exact[at] @ query).astype(np.int64) if small else vectors[at] @ self.queries[i]
            found = ids[at]
            good = found != self.ids[i]
            good &= scores >= least - abs(least) * SLACK
            if good.any():
                self.best[i] = _merge(known_ids, known, found[good], scores[good], self.k)

    def floors(self) -> np.ndarray:
        """The k-th score of each query, minus infinity where fewer are known."""
        return np.array([float(b[1][-1]) if len(b[1]) == self.k else -np.inf for b in self.best])

    def reach(self) -> float:
        """Length from which on a vector can still help a query of the block."""
        floors = self.floors()
        if (floors <= 0).any() or not len(floors):
            return 0.0
        return float((floors / self.norms).min()) * (1 - SLACK)


def _parts(packs: DataFrame, size: int) -> tuple[int, object]:
    """How many parts of about ``size`` packs each there are, and the part of every pack."""
    n = -(-packs.count() // size) or 1
    return n, F.pmod(F.xxhash64("pack"), F.lit(n)).cast("int")


def _band(length):
    """Number of the band of a length; it never falls where the length grows."""
    return F.when(length > 0, F.floor(F.log2(length) * BANDS)).otherwise(NO_LENGTH).cast("int")


def _with_floors(blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """Blocks with the floors that the longest bucket gives them and the band of length that can still help (``need``)."""
    lead = buckets.groupBy("dim").agg(F.max_by("pack", "norm2").alias("pack"))  # a number for each length in components
    lines, line = _parts(blocks, CELL_BLOCKS)
    longest = buckets.join(lead, ["dim", "pack"], "left_semi").select(
        "dim", "ids", "matrix", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"))
    shown = blocks.select("dim", F.col("pack").alias("block"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"),
                          line.alias("line")).join(longest.hint("merge"), ["dim", "line"]).drop("line")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                dim, block, q_ids, q_matrix, ids, matrix = (c[r].as_py() for c in batch.columns)
                state = Retrieval(np.frombuffer(q_ids, np.int64), np.frombuffer(q_matrix, np.int64).reshape(-1, dim), k)
                state.bucket(np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int64).reshape(-1, dim))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([block], pa.int64()), pa.array([q_ids], pa.binary()),
                     pa.array([q_matrix], pa.binary()), pa.array([state.floors().tobytes()], pa.binary()), pa.array([state.reach()])],
                    names=["dim", "block", "q_ids", "q_matrix", "floors", "reach"])

    known = shown.mapInArrow(run, "dim int, block bigint, q_ids binary, q_matrix binary, floors binary, reach double")
    return known.withColumn("need", _band(F.col("reach"))).drop("reach")


def meets(blocks: DataFrame, buckets: DataFrame) -> DataFrame:
    """Every block of queries beside every bucket that is long enough for it, in cells of a grid for each pair of bands."""
    blocks = blocks.withColumnRenamed("block", "pack")
    buckets = buckets.withColumn("band", _band(F.sqrt("norm2")))
    count = lambda packs, band, size, name: packs.groupBy("dim", band).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    # Bands are few, whatever the number of rows: a row here is a pair of them.
    pairs = shared_table(count(blocks, "need", CELL_BLOCKS, "lines").join(count(buckets, "band", CELL_BUCKETS, "columns"), "dim").where(
        "band >= need"))
    dealt = lambda parts: F.pmod(F.xxhash64("pack"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = blocks.join(pairs, ["dim", "need"]).select(
        "dim", "need", "band", F.col("pack").alias("block"), "q_ids", "q_matrix", "floors", dealt("lines").alias("line"),
        each("columns").alias("column"))
    right = buckets.join(pairs, ["dim", "band"]).select(
        "dim", "need", "band", "norm2", "ids", "matrix", dealt("columns").alias("column"), each("lines").alias("line"))
    return left.join(right.hint("merge"), ["dim", "need", "band", "line", "column"])


def packed(df: DataFrame, key: str, vector: str, scale: float, size: int) -> DataFrame:
    """The vectors of ``df`` in packs of ``size`` rows of similar length, stored."""
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), integers(F.col(f"`{vector}`"), scale).alias("v"))
    rows = rows.where("id is not null and v is not null and size(v) > 0").withColumn("dim", F.size("v"))
    rows = rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    order = [F.col("dim"), F.col("norm2").desc(), F.col("id"), F.xxhash64("v")]
    return shared_table(_packs(rows.repartitionByRange(*order).sortWithinPartitions(*order), size))


def top_products(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of each query with all rows but its own.

    ``df`` and ``queries`` have an integer ``key`` and a ``vector``. Ties go to the smaller id. Rows with a NULL id or
    a vector that is NULL or holds NULL or a non-finite component take no part; vectors meet only those of the same
    length in components. Rows repeated as they are count once. Scores are exact while they fit in 64 bits.
    Blocks of queries and buckets meet in the cells of a grid, whose size does not depend on the data, so no side is
    held whole anywhere; only buckets that are long enough for a block are sent to it.
    """
    buckets = packed(df, key, vector, scale, BUCKET_ROWS)
    blocks = shared_table(_with_floors(packed(queries, key, vector, scale, QUERY_ROWS), buckets, k))
    flow = meets(blocks, buckets).select(
        "block", "band", "column", "dim", "norm2", "q_ids", "q_matrix", "floors", "ids", "matrix").sortWithinPartitions(
        "block", "band", "column", F.col("norm2").desc())

    def run(batches):
        now, state = None, None

        def result():
            sizes = [len(b[0]) for b in state.best]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(state.ids, sizes)), pa.array(np.concatenate([b[0] for b in state.best])),
                 pa.array(np.concatenate([b[1] for b in state.best]))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                block, band, column, dim, _, q_ids, q_matrix, floors, ids, matrix = (c[r].as_py() for c in batch.columns)
                if (block, band, column) != now:
                    if state:
                        yield result()
                    now, state = (block, band, column), Retrieval(
                        np.frombuffer(q_ids, np.int64), np.frombuffer(q_matrix, np.int64).reshape(-1, dim), k, np.frombuffer(floors))
                state.bucket(np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int64).reshape(-1, dim))
        if state:
            yield result()

    partial = flow.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

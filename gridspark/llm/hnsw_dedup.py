"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Vectors of one label (and dimension) are dealt to shards of bounded size by the hash of their id, so a label with a
third of all rows becomes many shards. A task builds the graph of a shard in numpy; every shard of a label is then
queried with every shard of the label, in both directions. A query walks down the layers and keeps a beam on the lowest
one; its hits join vectors into groups, and inside a group every pair is verified by its cosine in double precision,
so a group larger than the beam loses no link. Audits compare sampled queries with brute force over the shard; while
they find too small a share of the links, the beam is doubled and all queries are asked again, up to the whole shard.
A task reports for each vector the number of links and the least member of its group, so a group of near copies
costs rows in proportion to its size.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import shared_table
from .components import components

THRESHOLD = 0.93
SHARD_ROWS = 8192
LINKS = 16  # of a node on each layer; twice as many on the lowest
BUILD_BEAM = 32
BEAM = 32
AUDITS = 256  # sampled queries in each direction
RECALL = 0.995  # share of the links of the sampled queries that has to be found
STEP = 512  # queries that walk together
_WIDTH = 3  # beam members that are expanded together


def _pick(scores: np.ndarray, cross: np.ndarray, count: int) -> np.ndarray:
    """Which candidates to link: from the best on, those nearer to the node than to any picked one; then the best rest.

    ``scores`` is (nodes, candidates), -inf where there is none; ``cross`` (nodes, candidates, candidates).
    Returns (nodes, count) candidate places, -1 where there are too few.
    """
    n, m = scores.shape
    order = np.argsort(-scores, 1, kind="stable")
    closest = np.full((n, m), -np.inf)  # similarity to the nearest picked candidate
    taken = np.zeros((n, m), bool)
    rows = np.arange(n)
    total = np.zeros(n, int)
    for k in range(m):
        at = order[:, k]
        good = (scores[rows, at] > closest[rows, at]) & np.isfinite(scores[rows, at]) & (total < count)
        taken[rows[good], at[good]] = True
        total += good
        closest[good] = np.maximum(closest[good], cross[rows[good], at[good]])
    value = np.where(taken, scores + 4, np.where(np.isfinite(scores), scores, -np.inf))
    best = np.argsort(-value, 1, kind="stable")[:, :count]
    return np.where(np.isfinite(np.take_along_axis(value, best, 1)), best, -1)


class Graph:
    """A layered graph over unit vectors ``x``; ``layers[0]`` is the lowest, each an (n, links) table padded with -1."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry
        self.light = x.astype(np.float32)  # for walking; links are verified with x

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 11) -> Graph:
        n = len(x)
        draw = np.random.default_rng(seed)
        top = np.minimum((-np.log(draw.random(n) + 1e-12) / np.log(LINKS)).astype(int), 6)
        order = np.argsort(-top, kind="stable")  # the highest layers first, so every batch finds its layers in place
        graph = cls(x, [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(top.max() + 1)], int(order[0]))
        done, size = 0, 32
        while done < n:
            batch = order[done:done + size]
            graph._insert(batch, top, done > 0)
            done += len(batch)
            size = min(done, STEP)
        return graph

    def _insert(self, batch: np.ndarray, top: np.ndarray, search: bool) -> None:
        x = self.x
        entry = np.full((len(batch), 1), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            if search:
                found, _ = self._walk(k, x[batch], entry, BUILD_BEAM if k == 0 else BUILD_BEAM // 2)
                entry = found[:, :4]
            own = top[batch] >= k
            nodes = batch[own]
            if not len(nodes):
                continue
            inside = x[nodes] @ x[nodes].T
            np.fill_diagonal(inside, -np.inf)
            near = np.argsort(-inside, 1)[:, :BUILD_BEAM]
            candidates = nodes[near]
            if search:
                before = found[own]
                candidates = np.concatenate([before, candidates], 1)
            self._link(k, nodes, candidates)

    def _link(self, k: int, nodes: np.ndarray, candidates: np.ndarray) -> None:
        table = self.layers[k]
        for a in range(0, len(nodes), 128):
            table[nodes[a:a + 128]] = self._choose(nodes[a:a + 128], candidates[a:a + 128], table.shape[1])
        # The other direction: new neighbours of a node are weighed against those it has.
        sources = np.repeat(nodes, table.shape[1])
        targets = table[nodes].ravel()
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[sources], self.x[targets]), targets))
        sources, targets = sources[order], targets[order]
        unique, first, counts = np.unique(targets, return_index=True, return_counts=True)
        rank = np.arange(len(targets)) - np.repeat(first, counts)
        fits = rank < table.shape[1]
        incoming = np.full((len(unique), table.shape[1]), -1, np.int32)
        incoming[np.repeat(np.arange(len(unique)), counts)[fits], rank[fits]] = sources[fits]
        for a in range(0, len(unique), 128):
            u = unique[a:a + 128]
            table[u] = self._choose(u, np.concatenate([table[u], incoming[a:a + 128]], 1), table.shape[1])

    def _choose(self, nodes: np.ndarray, candidates: np.ndarray, count: int) -> np.ndarray:
        candidates = np.sort(candidates, 1)
        valid = candidates >= 0
        valid[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
        valid &= candidates != nodes[:, None]
        near = self.x[np.maximum(candidates, 0)]
        scores = np.where(valid, np.matmul(near, self.x[nodes][:, :, None])[:, :, 0], -np.inf)
        picked = _pick(scores, np.matmul(near, near.transpose(0, 2, 1)), count)
        out = np.where(picked >= 0, np.take_along_axis(candidates, np.maximum(picked, 0), 1), -1)
        if out.shape[1] < count:
            out = np.pad(out, ((0, 0), (0, count - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _walk(self, k: int, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries at once; (ids, scores) by falling score, -1 and -inf where there is none."""
        n, x, table = len(queries), self.light, self.layers[k]
        queries = queries.astype(np.float32)
        seen = np.zeros((n, len(x) + 1), bool)  # the last column takes the padding
        seen[:, -1] = True
        ids = np.full((n, beam), -1, np.int64)
        scores = np.full((n, beam), -np.inf, np.float32)
        opened = np.ones((n, beam), bool)
        live, new = np.arange(n), entries
        while len(live):
            new = np.sort(new, 1)
            fresh = ~seen[live[:, None], new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[live[:, None], new] = True
            row, at = np.nonzero(fresh)
            value = np.full(new.shape, -np.inf, np.float32)
            value[row, at] = np.einsum("ij,ij->i", x[new[row, at]], queries[live[row]])
            all_scores = np.concatenate([scores[live], value], 1)
            best = np.argsort(-all_scores, 1, kind="stable")[:, :beam]
            scores[live] = np.take_along_axis(all_scores, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], new], 1), best, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], ~fresh], 1), best, 1)
            closed = ~opened[live] & np.isfinite(scores[live])
            live = live[closed.any(1)]
            if not len(live):
                break
            closed = ~opened[live] & np.isfinite(scores[live])
            first = np.argsort(~closed, 1, kind="stable")[:, :_WIDTH]  # the best that are not yet opened
            real = np.take_along_axis(closed, first, 1)
            opened[live[:, None], first] = True
            at = np.where(real, ids[live[:, None], first], 0)
            new = np.where(real[:, :, None], table[at], -1).reshape(len(live), -1)
        return ids, scores

    def near(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(queries), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self._walk(k, queries, entry, 4)[0]
        return self._walk(0, queries, entry, min(beam, len(self.x)))


def _save(graph: Graph) -> bytes:
    file = io.BytesIO()
    np.savez(file, x=graph.x, entry=graph.entry, **{f"layer{k}": t for k, t in enumerate(graph.layers)})
    return file.getvalue()


def _load(data: bytes) -> Graph:
    with np.load(io.BytesIO(data)) as f:
        return Graph(f["x"], [f[f"layer{k}"] for k in range(sum(n.startswith("layer") for n in f.files))], int(f["entry"]))


def _ask(graph: Graph, queries: np.ndarray, threshold: float, beam: int, linked: np.ndarray) -> None:
    """Mark the vectors of ``graph`` (columns) that the beams of the queries (rows) hold above the threshold."""
    for a in range(0, len(queries), STEP):
        ids, scores = graph.near(queries[a:a + STEP], beam)
        row, at = np.nonzero(scores >= threshold - 1e-4)
        linked[a + row, ids[row, at]] = True


def _verify(a: Graph, b: Graph, same: bool, threshold: float, linked: np.ndarray) -> None:
    """Inside each group that the marks join, take every pair by its cosine."""
    ids = np.arange(len(a.x))
    rows, columns = _least(linked, ids, ids if same else np.full(len(b.x), np.iinfo(np.int64).max), same)
    row_order, column_order = np.argsort(rows, kind="stable"), np.argsort(columns, kind="stable")
    groups, sizes = np.unique(rows, return_counts=True)
    low, high = np.searchsorted(columns[column_order], groups), np.searchsorted(columns[column_order], groups, "right")
    ends = np.cumsum(sizes)
    for k in np.flatnonzero((high - low >= 1) & ((sizes > 1) | (not same))):
        inside = column_order[low[k]:high[k]]
        own = row_order[ends[k] - sizes[k]:ends[k]]
        for at in range(0, len(own), STEP):
            part = own[at:at + STEP]
            linked[np.ix_(part, inside)] = a.x[part] @ b.x[inside].T >= threshold
    if same:
        np.fill_diagonal(linked, False)


def _share(queries: np.ndarray, graph: Graph, threshold: float, found: np.ndarray, same: bool) -> tuple[int, int]:
    """(sampled queries with links by brute force, those of them whose links were all found)."""
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDITS, len(queries))).astype(int))
    truth = queries[sample] @ graph.x.T >= threshold
    if same:
        truth[np.arange(len(sample)), sample] = False
    some = truth.any(1)
    return int(some.sum()), int((some & ~(truth & ~found[sample]).any(1)).sum())


def _copies_linked(linked: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For each row the copies of all columns it is linked with; in blocks, for a product casts the whole matrix."""
    return np.concatenate([linked[at:at + STEP] @ copies for at in range(0, len(linked), STEP)])


def _meet(a: Graph, b: Graph, same: bool, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, int, int]:
    """Which vectors of ``a`` (rows) and ``b`` (columns) are linked; asked in both directions, audited and verified.

    Also the counts of the audit: sampled vectors with links, and those whose links were all found.
    """
    linked = np.zeros((len(a.x), len(b.x)), bool)
    while True:
        _ask(b, a.x, threshold, beam, linked)
        if same:
            linked |= linked.T
            np.fill_diagonal(linked, False)
        else:
            _ask(a, b.x, threshold, beam, linked.T)
        _verify(a, b, same, threshold, linked)
        checks = [_share(a.x, b, threshold, linked, same)] + ([] if same else [_share(b.x, a, threshold, linked.T, same)])
        if beam >= max(len(a.x), len(b.x)) or all(found >= RECALL * true for true, found in checks):
            return linked, *(sum(c[i] for c in checks) for i in (0, 1))
        beam *= 2


def _least(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each row and column reaches over the links of one block."""
    rows, columns = rows.copy(), rows if same else columns.copy()
    with_row, with_column = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    top = np.iinfo(np.int64).max
    while True:
        before = rows.copy(), columns.copy()
        for at in with_row:
            rows[at] = min(rows[at], columns[linked[at]].min(initial=top))
        if same:
            columns = rows
        for at in with_column:
            columns[at] = min(columns[at], rows[linked[:, at]].min(initial=top))
        if same:
            rows = columns
        if (before[0] == rows).all() and (before[1] == columns).all():
            return rows, columns


def near_duplicates(df: DataFrame, key: str, vector: str, label: str, threshold: float = THRESHOLD,
                    shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, n_links, component_id, kept) of each vector.

    Vectors link if their labels and dimensions are equal and their cosine is at least ``threshold``. A NULL label, a
    vector that is NULL, empty or zero, or that holds NULL or a non-finite component, links with nothing. Rows
    repeated as they are count once; ids are otherwise unique, and rows with a NULL id are left out. Exact copies are one node of
    the graph, and each of them links with the others. An empty table gives no rows. Other columns are not read.
    """
    wide = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(wide, lambda x: x != 0)
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").alias("label"),
                     F.when(fine, wide).alias("v")).where("id is not null").distinct()
    nodes = shared_table(rows.where("label is not null and v is not null").groupBy("label", "v").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v")))
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")))

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        raw = table["v"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        raw = raw / np.abs(raw).max(1, keepdims=True)
        graph = Graph.build(raw / np.sqrt((raw ** 2).sum(1, keepdims=True)))
        return pa.table({"label": table["label"][:1], "dim": table["dim"][:1], "shard": table["shard"][:1],
                         "reps": pa.array([table["rep"].to_numpy().tobytes()], pa.binary()),
                         "copies": pa.array([table["copies"].to_numpy().tobytes()], pa.binary()),
                         "graph": pa.array([_save(graph)], pa.binary())})

    kind = nodes.schema["label"].dataType.simpleString()
    shards = shared_table(dealt.groupBy("label", "dim", "shard").applyInArrow(
        index, f"label {kind}, dim int, shard bigint, reps binary, copies binary, graph binary"))
    other = shards.select("label", "dim", *[F.col(c).alias(f"{c}_2") for c in ("shard", "reps", "copies", "graph")])
    # Pairs of shards of one label, each dealt to a task of its own; a pair is a few MB.
    names = shards.select("label", "dim", "shard")
    pairs = names.join(names.withColumnRenamed("shard", "shard_2"), ["label", "dim"]).where("shard <= shard_2")
    meets = (pairs.join(shards.hint("merge"), ["label", "dim", "shard"]).join(other.hint("merge"), ["label", "dim", "shard_2"])
             .select("shard", "shard_2", "reps", "copies", "graph", "reps_2", "copies_2", "graph_2")
             .repartition(F.xxhash64("reps", "reps_2")))

    def link(batches, beam):
        for batch in batches:
            for r in range(batch.num_rows):
                s1, s2, *data = (c[r].as_py() for c in batch.columns)
                reps, copies, reps2, copies2 = (np.frombuffer(data[i], np.int64) for i in (0, 1, 3, 4))
                a, same = _load(data[2]), s1 == s2
                linked, true, met = _meet(a, a if same else _load(data[5]), same, threshold, beam)
                roots, roots2 = _least(linked, reps, reps2, same)
                out = [(reps, _copies_linked(linked, copies2), roots)] + (
                    [] if same else [(reps2, _copies_linked(linked.T, copies), roots2)])
                columns = [np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(3)]
                audit = [np.concatenate([[n], np.zeros(len(columns[0]) - 1, np.int64)]) for n in (true, met)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, *audit)], names=["rep", "links", "root", "audited", "met"])

    beam = BEAM
    while True:  # one pass, unless the audits of all meets together find too many links missing
        found = shared_table(meets.mapInArrow(lambda batches, beam=beam: link(batches, beam),
                                              "rep bigint, links bigint, root bigint, audited bigint, met bigint"))
        audit = found.agg(F.coalesce(F.sum("audited"), F.lit(0)).alias("audited"), F.coalesce(F.sum("met"), F.lit(0)).alias("met")).first()
        if audit["met"] >= RECALL * audit["audited"] or beam >= shard_rows:
            break
        beam *= 2
    parts = components(found.where("rep <> root"), "rep", "root")
    per_node = found.groupBy("rep").agg(F.sum("links").alias("links"))
    state = nodes.join(per_node, "rep").join(parts, F.col("rep") == F.col("node"), "left").select(
        F.col("label").alias("l"), F.col("v").alias("w"), (F.col("links") + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"))
    done = rows.join(state, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    part = F.coalesce("component_id", "id")
    return done.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                       part.alias("component_id"), (F.col("id") == part).alias("kept"))

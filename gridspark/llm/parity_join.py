"""N-gram Jaccard join by parity sketches.

A document is its set of hashed word shingles. A parity sketch deals the shingles to positions by hash and keeps the XOR
at each position, so the number of positions in which two sketches differ is never above the symmetric difference of
the sets. Two sizes of sketch are used:

* For the join, a band of set sizes has k wide positions (64 bits each, the XOR of the shingle hashes that fell there).
  A Jaccard of 3/4 allows a set of n shingles at most n / 3 differences, so of its filled positions only that many can
  differ: partners share a position by the pigeonhole principle. A document emits as keys enough positions, those with
  most shingles first, that partners share at least ``need`` of them; documents whose keys are shared less often have
  no partner, which removes those that only share a line or a passage, whatever its frequency.
* To check candidates, a sketch of single bits is compared by its Hamming distance before sets are intersected.

Equal sets are one class, and a task holds each class once. First every class is compared with the hub it shares most
keys with; the hub of a key is its holder with most shared keys, which in a group of near copies is the least edited
one. Classes that share a fifth of their keys with their hub form clusters, and clusters that meet in a key
with many holders are joined. Inside a cluster, blocks of sketches meet each
other in numpy, so a group of near copies never becomes rows of pairs; only pairs that pass the sketches do. Between
clusters, classes that share a key are compared, over their rarest keys only: among m shared keys, m - need + 1 are
enough. Pairs that are in one component already are left out, and all others are covered, so the result is exact.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import computed, handing_back, shared_table, steps
from .components import components

WORDS = 5
SEEDS = 4  # ways to deal the shingles of a small set, tried until partners must share a filled position
BUCKET_BYTES = 24 << 20  # of keys in one task
BLOCK_CLASSES = 1024
CROWDED = 32  # holders of a key from which its clusters are joined
SLICE_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, (64, 256), np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
# Characters whose words are hashed at once; a longer text is a step by itself.
SHINGLE_CHARS = 1 << 19


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words between ASCII white space."""
    data = np.frombuffer(raw, np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, ends - starts)
    value = _TABLE[place & 63, data[at]]
    if place.max() >= 64:
        value = value * (2 * (place >> 6) + 1).astype(np.uint64)
    firsts = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    return mix(np.add.reduceat(value, firsts) + (ends - starts).astype(np.uint64)), starts


def _chain(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    size = len(words) - width + 1
    out = np.full(size, width, np.uint64)
    for k in range(width):
        out = (out ^ words[k:k + size]) * _ODD
        out ^= out >> np.uint64(32)
    return mix(out)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of whole texts; NULL and texts without words give an empty set."""
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    if sum(map(len, raws)) > SLICE_BYTES and len(raws) == 1:  # a very long text: hash its words slice by slice
        raw, parts, at = raws[0], [], 0
        while at < len(raw):
            end = at + SLICE_BYTES
            while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
                end += 1
            parts.append(word_hashes(raw[at:end])[0])
            at = end
        words, owners = np.concatenate(parts), [(0, sum(map(len, parts)))]
    else:
        words, starts = word_hashes(b"\n".join(raws))
        limits = np.cumsum([len(r) + 1 for r in raws])
        cuts = np.concatenate([[0], np.searchsorted(starts, limits)])
        owners = list(zip(cuts[:-1], cuts[1:]))
    full = _chain(words, WORDS) if len(words) >= WORDS else np.zeros(0, np.uint64)
    out = []
    for a, b in owners:
        if b - a >= WORDS:
            out.append(np.unique(full[a:b - WORDS + 1]))
        else:
            out.append(_chain(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def class_hash(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Parity of each of a power of two of bits, about four for a shingle, from 256 to 32768."""
    bits = min(max(256, 1 << int(4 * len(shingles) - 1).bit_length()), 1 << 15)
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches; the longer one is folded, which keeps the parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def emissions(shingles: np.ndarray, cls: int) -> list[tuple[int, int, np.ndarray]]:
    """(emission, need, keys) of one set.

    Sizes from lo to 2 lo - 1 form a band, with lo + 4 positions. The lowest third of a band also takes part in the
    band below, where its smaller partners are. A partner shares at least ``need`` of the keys: the same number for all
    of a band, but for sets with few filled positions, which emit all of them. Where so many are empty that partners
    need not share a filled one, the shingles are dealt anew, and after SEEDS dealings empty positions count as keys.
    """
    n = len(shingles)
    if not n:
        return []
    out, own = [], n.bit_length() - 1
    low = 1 << own
    for band in [own] + ([own - 1] if own and 3 * n <= 4 * (low - 1) else []):
        k, want = (1 << band) + 4, (1 << band) // 7 + 1
        # Differences are at most a seventh of both sizes; partners in the band below have low - 1 at most.
        most = n // 3 if band == own else (n + low - 1) // 7
        for seed in range(SEEDS):
            tag = np.uint64((band * SEEDS + seed + 1) * int(_ODD) & (1 << 64) - 1)
            with np.errstate(over="ignore"):
                place = (mix(shingles + tag) % np.uint64(k)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            filled, first, count = np.unique(place[order], return_index=True, return_counts=True)
            value = np.bitwise_xor.reduceat(shingles[order], first)
            keys = mix(mix(value) + filled.astype(np.uint64) * _ODD + tag)
            slack, need = len(filled) - most, 1  # partners share at least ``slack`` of the filled positions
            if slack >= want:
                # In any order that depends on a position's content alone, the first ``want`` shared positions are
                # among the first most + want of both partners. Full positions come first; they are the rarest.
                keys, need = keys[np.lexsort((keys, -count))[:most + want]], want
            elif slack >= 1:
                need = slack  # all filled positions
            elif seed == SEEDS - 1:
                empty = np.setdiff1d(np.arange(k), filled).astype(np.uint64)
                keys = np.concatenate([keys, mix(empty * _ODD + tag)])
            mark = int(mix(np.array([cls], np.int64).view(np.uint64) + tag)[0].astype(np.int64))
            out.append((mark, need, keys))
            if slack >= 1:
                break
    return out


def _described(texts: list[str | None], ids: list) -> list[list]:
    n, cls, sketch, marks, needs = [], [], [], [], []
    for a, b in steps(texts, SHINGLE_CHARS):
        for s in shingle_sets(texts[a:b]):
            c = class_hash(s)
            made = emissions(s, c)
            n.append(len(s))
            cls.append(c)
            sketch.append(bit_sketch(s) if len(s) else b"")
            marks.append([m for m, _, _ in made])
            needs.append([w for _, w, _ in made])
    return [n, cls, sketch, marks, needs]


def _keys(documents: DataFrame, text: str, buckets: int) -> DataFrame:
    """(key, mark) of all classes, dealt to ``buckets`` tasks by key and sorted there by Spark, which may spill.

    Keys travel as packed blocks, one for each bucket and step of a task; a step makes its sets part by part.
    """

    def pack(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in steps(texts, 1 << 22):
                seen, marks, sizes, keys = set(), [], [], []
                for s in (s for i, j in steps(texts[a:b], SHINGLE_CHARS) for s in shingle_sets(texts[a + i:a + j])):
                    c = class_hash(s)
                    if c not in seen:  # copies within a step go once
                        seen.add(c)
                        for mark, _, own in emissions(s, c):
                            marks.append(mark)
                            sizes.append(len(own))
                            keys.append(own)
                if not keys:
                    continue
                key, owner = np.concatenate(keys), np.repeat(np.arange(len(marks), dtype=np.uint32), sizes)
                bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                key, owner, mark = key[order], owner[order], np.array(marks, np.int64)
                at = [i for i in range(buckets) if ends[i] < ends[i + 1]]
                owners = [np.unique(owner[ends[i]:ends[i + 1]], return_inverse=True) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array([key[ends[i]:ends[i + 1]].tobytes() for i in at], pa.binary()),
                     pa.array([w.astype(np.uint32).tobytes() for _, w in owners], pa.binary()),
                     pa.array([mark[o].tobytes() for o, _ in owners], pa.binary())],
                    names=["bucket", "keys", "owners", "marks"])

    def unpack(batches):
        for batch in batches:
            for keys, owners, marks in zip(*(batch.column(i) for i in (1, 2, 3))):
                key = np.frombuffer(keys.as_buffer(), np.int64)
                mark = np.frombuffer(marks.as_buffer(), np.int64)[np.frombuffer(owners.as_buffer(), np.uint32)]
                for a in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[a:a + 100_000]), pa.array(mark[a:a + 100_000])],
                                                     names=["key", "mark"])

    packed = documents.select(F.col(f"`{text}`").alias("t")).mapInArrow(
        handing_back(pack), "bucket int, keys binary, owners binary, marks binary")
    # The bucket is the number of its task; a hash of it would put several buckets into one task and none into others.
    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(handing_back(unpack), "key bigint, mark bigint").sortWithinPartitions("key", "mark")


def _shared_keys(batches):
    """Of sorted (key, mark) rows, those whose key has two marks or more, each once; one row is held back."""
    key, mark, used = None, None, False
    for batch in batches:
        keys, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        if key is not None:
            keys, marks = np.concatenate([[key], keys]), np.concatenate([[mark], marks])
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])
        keys, marks = keys[fresh], marks[fresh]
        same = keys[1:] == keys[:-1]
        out = np.zeros(len(keys), bool)
        out[1:] |= same
        out[:-1] |= same
        if key is not None and used:
            out[0] = False  # already given
        # The last row waits for its neighbour unless it is already known to be shared.
        key, mark, used = keys[-1], marks[-1], bool(out[-1]) or (len(keys) == 1 and used)
        yield pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array(marks[out])], names=["key", "mark"])


class JaccardJoin:
    """The steps of one join over ``documents`` (id, text); see ``jaccard_components``."""

    def __init__(self, documents: DataFrame, key: str, text: str):
        rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t"))
        self.rows = rows.where("id is not null")
        fields = [T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()),
                  T.StructField("sketch", T.BinaryType()), T.StructField("marks", T.ArrayType(T.LongType())),
                  T.StructField("needs", T.ArrayType(T.IntegerType()))]
        self.described = shared_table(computed(self.rows, ["t", "id"], fields, lambda: _described, ["id"]))

    def links(self) -> DataFrame:
        """Links (a, b) between classes that join all that are connected."""
        total = self.described.agg(F.sum("n")).first()[0] or 0
        buckets = max(1, int(total * 0.6 * 12 / BUCKET_BYTES), int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        shared = shared_table(_keys(self.rows, "t", buckets).mapInArrow(handing_back(_shared_keys), "key bigint, mark bigint"))
        classes = self.described.where("n > 0").groupBy("cls").agg(
            F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
            F.first("marks").alias("marks"), F.first("needs").alias("needs"))
        self.classes = shared_table(classes)
        marks = self.classes.select("cls", F.explode(F.arrays_zip("marks", "needs")).alias("e")).select(
            "cls", F.col("e.marks").alias("mark"), F.col("e.needs").alias("need"))
        often = shared.groupBy("mark").agg(F.count("*").alias("m")).join(marks, "mark").where("m >= need")
        # Keys of classes that may have a partner, and of these the rarest that are enough to meet it.
        of_key, of_mark = Window.partitionBy("key"), Window.partitionBy("mark")
        held = shared.join(often, "mark").withColumn("f", F.count("*").over(of_key)).where("f > 1")
        held = held.withColumn("m", F.count("*").over(of_mark)).where("m >= need").withColumn(
            "rare", F.row_number().over(of_mark.orderBy("f", "key")) <= F.col("m") - F.col("need") + 1)
        keys = shared_table(held.select("key", "cls", "m", "rare"))
        hubs = keys.withColumn("hub", F.max(F.struct("m", "cls")).over(of_key)).where("hub.cls <> cls")
        best = shared_table(hubs.groupBy("cls", F.col("hub.cls").alias("b")).agg(
            F.count("*").alias("c"), F.max("m").alias("m")).groupBy("cls").agg(F.max(F.struct("c", "b", "m")).alias("best"))
            .select(F.col("cls").alias("a"), "best.*"))
        near = self.verified(best.select("a", "b"))
        part = components(near, "a", "b").withColumnRenamed("component_id", "part")
        cluster = components(best.where("5 * c >= m").select("a", "b"), "a", "b").withColumnRenamed("component_id", "cluster")
        members = shared_table(keys.select("cls").distinct().join(part.withColumnRenamed("node", "cls"), "cls", "left").join(
            cluster.withColumnRenamed("node", "cls"), "cls", "left").select(
            "cls", F.coalesce("part", "cls").alias("part"), F.coalesce("cluster", "cls").alias("cluster")))
        # Clusters that meet in a key with many holders become one.
        crowded = keys.where("rare").select("key", "cls").join(members, "cls").withColumn("g", F.count("*").over(of_key)).where(
            F.col("g") >= CROWDED).withColumn("x", F.min("cluster").over(of_key)).where("cluster <> x")
        merged = components(crowded.select("cluster", "x").distinct(), "cluster", "x")
        members = shared_table(members.join(merged, F.col("cluster") == F.col("node"), "left").select(
            "cls", "part", F.coalesce("component_id", "cluster").alias("cluster")))
        pairs = self.inside(members).union(self.across(keys.where("rare").select("key", "cls").join(members, "cls")))
        return near.union(self.verified(pairs.distinct()))

    def across(self, placed: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes of different clusters and components that share a key."""
        of_key = Window.partitionBy("key")
        for c in ("part", "cluster"):
            placed = placed.withColumn(f"{c}_x", F.min(c).over(of_key)).withColumn(f"{c}_y", F.max(c).over(of_key))
        mixed = shared_table(placed.where("part_x <> part_y and cluster_x <> cluster_y").select("key", "cls", "part", "cluster"))
        other = mixed.select("key", F.col("cls").alias("b"), F.col("part").alias("part_b"), F.col("cluster").alias("cluster_b"))
        return mixed.withColumnRenamed("cls", "a").join(other, "key").where("part < part_b and cluster <> cluster_b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def inside(self, members: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes of one cluster and different components whose sizes and sketches are near enough."""
        sizes = members.groupBy("cluster").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("g")).where(
            "x <> y").select("cluster", F.ceil(F.col("g") / BLOCK_CLASSES).alias("blocks"))
        rows = members.join(sizes, "cluster").join(self.classes.select("cls", "n", "sketch"), "cls").select(
            "cluster", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"), "cls", "part", "n", "sketch")
        packs = shared_table(rows.groupBy("cluster", "block").agg(F.collect_list(F.struct("cls", "part", "n", "sketch")).alias("own")))
        other = packs.select("cluster", F.col("block").alias("block_2"), F.col("own").alias("own_2"))
        meets = packs.join(other, "cluster").where("block <= block_2").select("own", "own_2").repartition(F.xxhash64("own", "own_2"))

        def sides(own):
            by_size: dict[int, list] = {}
            for i, sketch in enumerate(own.field("sketch")):
                by_size.setdefault(len(sketch.as_buffer()), []).append(i)
            for size, at in by_size.items():
                data = np.frombuffer(b"".join(own.field("sketch")[i].as_py() for i in at), np.uint64).reshape(len(at), -1)
                yield size, data, *(own.field(c).to_numpy()[at] for c in ("cls", "part", "n"))

        def compare(batches):
            for batch in batches:
                out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for r in range(batch.num_rows):
                    left, right = (list(sides(batch.column(c)[r].values)) for c in (0, 1))
                    for s1, x, c1, p1, n1 in left:
                        for s2, y, c2, p2, n2 in right:
                            if not s1 <= 2 * s2 <= 4 * s1:  # sizes differ by a third at most, so sketches by a doubling
                                continue
                            u = x if s1 <= s2 else x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
                            v = y if s2 <= s1 else y[:, :y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
                            for i in range(len(c1)):
                                apart = (p2 != p1[i]) & (4 * np.minimum(n1[i], n2) >= 3 * np.maximum(n1[i], n2))
                                at = np.flatnonzero(apart)
                                bits = np.bitwise_count(v[at] ^ u[i]).sum(1, dtype=np.int64)
                                at = at[7 * bits <= n1[i] + n2[at]]
                                out_a.append(np.minimum(c1[i], c2[at]))
                                out_b.append(np.maximum(c1[i], c2[at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

        return meets.mapInArrow(handing_back(compare), "a bigint, b bigint").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs of classes that link: sketches first, then whole sets."""
        brief = self.classes.select("cls", "rep", "n", "sketch")
        side = lambda s: brief.select(*[F.col(c).alias(f"{c}_{s}") for c in brief.columns])
        both = pairs.join(side("a"), F.col("a") == F.col("cls_a")).join(side("b"), F.col("b") == F.col("cls_b")).where(
            "4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")

        def near(batches):
            for batch in batches:
                a, b, n, m, x, y = (batch.column(i) for i in range(6))
                total = n.to_numpy() + m.to_numpy()
                good = np.array([7 * distance(p.as_py(), q.as_py()) <= t for p, q, t in zip(x, y, total)], bool)
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good))

        close = shared_table(both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(handing_back(near), "a bigint, b bigint"))
        wanted = close.select(F.col("a").alias("cls")).union(close.select("b")).distinct().join(
            self.classes.select("cls", "rep"), "cls")
        texts = self.rows.join(wanted, F.col("id") == F.col("rep")).select("cls", "t").dropDuplicates(["cls"])
        sets = shared_table(computed(texts, ["t"], [T.StructField("s", T.BinaryType())], lambda: lambda t: [
            [s.tobytes() for a, b in steps(t, SHINGLE_CHARS) for s in shingle_sets(t[a:b])]], ["cls"]))

        def exact(batches):
            for batch in batches:
                a, b, x, y = (batch.column(i) for i in range(4))
                good = []
                for p, q in zip(x, y):
                    p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * common >= 75 * (len(p) + len(q) - common))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

        joined = close.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("s_a")), "a").join(
            sets.select(F.col("cls").alias("b"), F.col("s").alias("s_b")), "b").select("a", "b", "s_a", "s_b")
        return shared_table(joined.mapInArrow(handing_back(exact), "a bigint, b bigint"))


def jaccard_components(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_shingles, component_id) of each document whose id is not NULL.

    Documents link if the Jaccard similarity of their sets of five-word shingles is 3/4 or more; component_id is the
    least id reachable by links. A text with fewer words is one shingle; NULL, empty and blank texts have none, and
    link with nothing. Equal sets always link. Repeated rows are returned as often as they stand there; ids are
    integers. An empty table gives no rows. Other columns are not read. Sets and classes are told apart by 64-bit hashes.
    """
    join = JaccardJoin(documents, key, text)
    parts = components(join.links(), "a", "b")
    placed = join.described.select("id", "n", "cls").join(parts, F.col("cls") == F.col("node"), "left").select(
        "id", "n", F.when(F.col("n") > 0, F.coalesce("component_id", "cls")).alias("part"))
    placed = shared_table(placed)
    least = placed.where("part is not null").groupBy("part").agg(F.min("id").alias("least"))
    return placed.join(least, "part", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))

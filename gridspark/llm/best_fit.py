"""Packing token pieces into sequences: best-fit decreasing with a segment tree over remaining capacities.

Pieces of one length are interchangeable, so the decisions of best-fit decreasing depend only on how many pieces each
length has: at most ``capacity`` numbers, whatever the size of the corpus. The driver takes that histogram from Spark
and runs the algorithm on it, with whole ranges of equal bins at a time; the segment tree finds the tightest open
remainder in logarithmic time. The outcome is a list of runs (length, ranks, bins). In a second pass every piece finds
its run by its rank among the pieces of its length, so the corpus is packed as a whole and not shard by shard.
"""

from __future__ import annotations

from array import array
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import STEP_CHARS, bounded_batches, shared_table, steps

CAPACITY = 2048


class Remainders:
    """Segment tree over remaining capacities 0..capacity: which are open, and the least open one from a size on."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def push(self, capacity: int, first: int, bins: int) -> None:
        if capacity and bins:
            self.ranges[capacity].append((first, bins))
            self._change(capacity, 1)

    def pop(self, capacity: int) -> tuple[int, int]:
        self._change(capacity, -1)
        return self.ranges[capacity].pop()

    def tightest(self, size: int) -> int | None:
        at = size + self.leaves
        if self.count[at]:
            return size
        while at > 1 and (at & 1 or not self.count[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing of ``{length: pieces}``. Returns runs and the number of sequences.

    A run is (length, first rank, pieces, pieces per bin, first bin, offset in the bin), sorted by length and rank.
    After a piece of length L the bin it went to is the tightest one while it still holds L, so a bin takes
    floor(remaining / L) pieces in a row, and equal bins can be filled as one range.
    """
    tree, runs, bins = Remainders(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            fresh = room is None
            room = capacity if fresh else room
            each = room // length
            first, have = (bins, left // each or 1) if fresh else tree.pop(room)
            used = min(have, left // each)
            if not used:
                used, each = 1, left
            runs.append((length, rank, used * each, each, first, capacity - room))
            tree.push(room - each * length, first, used)
            if fresh:
                bins += used
            else:
                tree.push(room, first + used, have - used)
            rank += used * each
            left -= used * each
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 6), bins


def place(lengths: np.ndarray, ranks: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces given by length and rank."""
    keys = runs[:, 0].astype(np.float64) * 2.0**41 + runs[:, 1]  # exact up to 2**41 pieces of a length
    at = np.searchsorted(keys, lengths.astype(np.float64) * 2.0**41 + ranks, side="right") - 1
    _, rank, _, each, first, offset = runs[at].T
    within = ranks - rank
    return first + within // each, offset + within % each * lengths


def ranked(df: DataFrame, length: str, capacity: int) -> DataFrame:
    """Append the task (``__task``) and the running number of each row among rows of its length there (``__rank``)."""
    schema = T.StructType(df.schema.fields + [T.StructField("__task", T.IntegerType()), T.StructField("__rank", T.LongType())])
    at = df.columns.index(length)

    def run(batches):
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            sizes = np.array(batch.column(at).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            sizes[(sizes < 1) | (sizes > capacity)] = 0
            order = np.argsort(sizes, kind="stable")
            new = np.bincount(sizes, minlength=capacity + 1)
            ranks = np.empty(len(sizes), np.int64)
            ranks[order] = np.arange(len(sizes)) - np.repeat(np.cumsum(new) - new, new)
            ranks += seen[sizes]
            seen += new
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sizes), task, np.int32)), pa.array(ranks)],
                names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def pack(df: DataFrame, length: str = "length", capacity: int = CAPACITY, sequence: str = "sequence_id",
         offset: str = "offset") -> DataFrame:
    """Append a sequence and an offset to each row, so that rows of a sequence follow one another without a gap.

    Lengths must be from 1 to ``capacity``; a row with another length or NULL is returned with NULL for both. Every
    row is a piece, repeated rows included; ties between equal lengths go by partition and row order. An empty table
    gives an empty result. Columns already called like the outputs are replaced.
    """
    spark = df.sparkSession
    source = df.drop(*[c for c in df.columns if c.lower() in {sequence.lower(), offset.lower()}])
    pieces = shared_table(ranked(source.withColumn("__size", F.col(f"`{length}`").cast("bigint")), "__size", capacity))
    fits = F.col("__size").between(1, capacity)
    counts = pieces.where(fits).groupBy("__size", "__task").agg(F.count("*").alias("__n"))
    # A row for each task and length, whose running total gives the ranks of the task.
    earlier = Window.partitionBy("__size").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = shared_table(counts.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0))))
    sums = bases.groupBy("__size").agg(F.sum("__n").alias("n")).collect()  # at most ``capacity`` rows
    runs, _ = plan({r["__size"]: r["n"] for r in sums}, capacity)
    shared = spark.sparkContext.broadcast(runs)  # a few rows for each length
    joined = pieces.join(bases.select("__size", "__task", "__base").hint("merge"), ["__size", "__task"], "left")
    kept = source.columns
    schema = T.StructType(source.schema.fields + [T.StructField(sequence, T.LongType()), T.StructField(offset, T.LongType())])

    def run(batches):
        for batch in batches:
            size, rank, base = (np.array(batch.column(len(kept) + i).fill_null(-1)) for i in range(3))
            bins, at, good = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), base >= 0
            if good.any():
                bins[good], at[good] = place(size[good], rank[good] + base[good], shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(bins, mask=~good), pa.array(at, mask=~good)],
                names=schema.fieldNames())

    return joined.select(*[F.col(f"`{c}`") for c in kept], "__size", "__rank", "__base").mapInArrow(run, schema)


# A stop right behind a letter begins a word of the split pattern. It is set off before a text is cut at its blanks, under a
# mark that says that no blank stood there; these letters are the same in every Unicode version.
MARK = "\ue000"
STOPS, SET_OFF = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([,.;:!?])", f"\\1 {MARK}\\2"
# Fixed value: the published split pattern of byte-level BPE.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACED = r"^($|[\t-\r\x1c-\x1f\x{85}\p{Z}])"  # nothing, or white space first
CACHED = 400_000
CHARS = 4 * STEP_CHARS  # text of one step, so that few words are looked up twice
JOINED = 4096  # words that the library encodes in one call
# Fixed value: the published letters of bytes; those that print stand for themselves, the others follow from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: chr(b) if b in _PRINTS else chr(256 + k) for k, b in enumerate(
    [b for b in range(256) if b not in _PRINTS] + _PRINTS)}
_encoders: dict[int, "Encoder"] = {}


class Encoder:
    """Token ids of whole texts, by the tokenizers library.

    Byte-level BPE never merges across its words, and a blank before another character always starts one. So texts
    are cut at their blanks and stops by Arrow, which also numbers their distinct parts. Parts are encoded once: those
    behind a blank stand in one string for the library, and a token that begins with the letter of the blank begins the
    next part. The ids of all parts stand in one flat array, from which the texts of a step are gathered at once. The
    array is begun anew when it holds CACHED parts. A text with white space after a blank or with a special token in it
    is cut by the split pattern itself.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items()}
        self.bpe = self.model.model.tokenize
        vocabulary = self.model.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)  # tokens that begin with a blank
        self.begins[[i for t, i in vocabulary.items() if t.startswith(LETTERS[32])]] = True
        self.clear()

    def clear(self) -> None:
        """Forget all parts, so that a worker that waits for other work holds no memory."""
        self.exact: dict[str, int] = {}  # numbers of parts as they stand
        self.after: dict[str, int] = {}  # numbers of parts behind one blank
        self.ids, self.starts, self.known, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0
        for token, number in self.special.items():
            self.exact[token] = self.known
            self._store(np.array([number], np.uint32), np.array([1]))

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append parts of ``sizes`` ids; part k has the ids from starts[k] to starts[k + 1]."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        if self.known + len(sizes) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(sizes) + 1), np.int64)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[self.known + 1:self.known + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.known += len(sizes)
        self.used += len(ids)

    def _encode(self, parts: list[str]) -> None:
        """Encode and store parts, word by word of the split pattern, by the library's model."""
        flat, ends, tokens = [], [], self.bpe
        for part in parts:
            body = part[1:] if part[:1] == " " else part
            if body.isascii() or max(body) < "\u0250":
                for word in (part,) if body.isalpha() else WORDS.findall(part):
                    flat += [t.id for t in tokens(word.encode().decode("latin-1").translate(LETTERS))]
            else:
                for word, _ in self.model.pre_tokenizer.pre_tokenize_str(part):
                    flat += [t.id for t in tokens(word)]
            ends.append(len(flat))
        self._store(np.array(flat, np.uint32), np.diff(np.array(ends, np.int64), prepend=0))

    def _encode_after(self, words: list[str]) -> None:
        """Encode and store words behind one blank each; words hold no blank and do not begin with white space."""
        for a in range(0, len(words), JOINED):
            some = [" " + w for w in words[a:a + JOINED]]
            ids = np.array(self.model.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(some):
                self._store(ids, np.diff(first, append=len(ids)))
            else:  # a definition that joins words over blanks
                self._encode(some)

    def _learn(self, after: list[str], exact: set[str]) -> None:
        new_after, new_exact = [w for w in after if w not in self.after], list(exact - self.exact.keys())
        if self.known + len(new_after) + len(new_exact) > CACHED and self.known > len(self.special):
            self.clear()
            new_after, new_exact = after, list(exact - self.exact.keys())
        plain, marked = [w for w in new_after if w[0] != MARK], [w for w in new_after if w[0] == MARK]
        self.after.update(zip(plain, range(self.known, self.known + len(plain))))
        self._encode_after(plain)
        self.after.update(zip(marked, range(self.known, self.known + len(marked))))
        self._encode([w[1:] for w in marked])
        self.exact.update(zip(new_exact, range(self.known, self.known + len(new_exact))))
        self._encode(new_exact)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        column = pa.array(texts, pa.large_string())
        cut = pc.split_pattern(pc.replace_substring_regex(column, STOPS, SET_OFF), " ")
        coded = cut.values.dictionary_encode()
        word, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        bounds = cut.offsets.to_numpy()
        leads, sizes = bounds[:-1], np.diff(bounds)  # every text has a first part, which follows no blank
        blank = pc.match_substring_regex(coded.dictionary, SPACED).to_numpy(zero_copy_only=False)[word]
        blank[leads] = False
        odd = np.logical_or.reduceat(blank, leads)
        for mark in (MARK, *self.special):
            odd |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        use = np.repeat(~odd, sizes)
        use[leads] = False
        used = np.zeros(len(words), bool)
        used[word[use]] = True
        after, heads = words[used].tolist(), words[word[leads[~odd]]].tolist()
        exact = set(heads)
        pieces = {i: self._pieces(texts[i]) for i in np.flatnonzero(odd).tolist()}
        exact.update(chain.from_iterable(pieces.values()))
        self._learn(after, exact)
        number = np.zeros(len(words), np.int64)
        number[used] = np.fromiter(map(self.after.__getitem__, after), np.int64, len(after))
        part = number[word]
        part[leads[~odd]] = [self.exact[h] for h in heads]
        if pieces:
            parts = np.split(part, bounds[1:-1])
            for i, found in pieces.items():
                parts[i] = np.array([self.exact[w] for w in found], np.int64)
                sizes[i] = len(found)
            part = np.concatenate(parts)
        starts = self.starts[part]
        lengths = self.starts[part + 1] - starts
        stops = np.cumsum(lengths)
        at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - lengths), lengths)
        return self.ids[at], np.concatenate([[0], stops])[np.cumsum(sizes)]

    def _pieces(self, text: str) -> list[str]:
        """Special tokens and words of the split pattern, in order."""
        pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        found = pattern.split(text) if pattern else [text]
        return [w for k, p in enumerate(found) for w in ([p] if k % 2 else WORDS.findall(p))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        ids, ends = self.flat(texts)
        return [p.astype("<u4").tobytes() for p in np.split(ids, ends[:-1])] if texts else []


def encoder(definition: str) -> Encoder:
    """One encoder for each definition and worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    key = hash(definition)
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def token_pieces(df: DataFrame, key: str, text: str, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Token pieces of whole texts: (key, piece, start, length, ids_crc32).

    A text is its ids followed by the id ``end``; NULL counts as empty. Longer ones than ``capacity`` are cut into
    pieces of it, with the shorter piece first. ``tokenizer`` is the path of a byte-level definition on the driver.
    Rows are never dropped; repeated keys give repeated pieces.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())  # a file of fixed size
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([rows.schema[0], *(T.StructField(n, k) for n, k in (
        ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))])
    last = array("I", [end]).tobytes()

    def run(batches):
        known = encoder(shared.value)
        flat = known.flat
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in steps(texts, CHARS):
                at, piece, start, length, crc = [], [], [], [], []
                ids, ends = flat([t or "" for t in texts[a:b]])
                raw, low = memoryview(ids.astype("<u4").tobytes()), 0
                for i, high in enumerate(ends.tolist(), a):
                    data, low = bytes(raw[4 * low:4 * high]) + last, high
                    n = len(data) // 4
                    begin, stop, number = 0, n % capacity or min(capacity, n), 0
                    while begin < n:
                        at.append(i)
                        piece.append(number)
                        start.append(begin)
                        length.append(stop - begin)
                        crc.append(crc32(data[4 * begin:4 * stop]))
                        begin, stop, number = stop, stop + capacity, number + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.fieldNames())
        known.clear()

    return rows.mapInArrow(run, schema)

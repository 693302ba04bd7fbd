"""Benchmark decontamination by Wu-Manber search over words.

Test strings are all windows of ``WINDOW`` consecutive words of the benchmark items; a shorter item is one window. Words
are numbers, so a block is two or three of them. A table tells for the hash of a block how far the scan may move before a
window can end; where it says zero, the hash of the block (the suffix) and of the first words (the prefix) select the windows
of one bucket, and these are compared word by word. All texts of a batch are scanned as one sequence, between words that
no item has.

Texts are never shuffled: a scan is one narrow pass. Windows reach the tasks in shards of at most ``SHARD_WORDS`` words,
so a broadcast is bounded whatever the size of the benchmark; with several shards the texts are scanned once for each, and
only the rows with hits are merged by a row number that is written once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import computed, shared_table

WINDOW = 10
SHARD_WORDS = 2_000_000
PIECE_WORDS = 20_000  # a longer item is cut into pieces that overlap by a window less one word
STEP_BYTES = 1 << 20  # bytes of text that one step of a scan takes; a longer text is a step by itself
# Windows up to which a block is two words long; with more of them pairs are too common to skip by.
PAIR_WINDOWS = 4096

# ASCII letters in lower case, digits and all bytes above ASCII are parts of words; every other byte is a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _roll(ids: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` words from each of the places ``first``."""
    code = np.zeros(len(first), np.uint64)
    for k in range(length):
        code = (code ^ ids[first + k].astype(np.uint64)) * _MULTIPLIER
        code ^= code >> np.uint64(29)
    return code


class Group:
    """Shift table and buckets of all windows of one length; windows are places in the words of the items."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, length: int):
        self.length, self.flat, self.starts = length, flat, starts
        self.block = min(length, 2 if len(starts) <= PAIR_WINDOWS else 3)
        bits = max(12, int(len(starts)).bit_length() + 4)
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - self.block + 1, np.uint8)
        for end in range(self.block, length + 1):  # a block that ends after ``end`` words lets the scan move to the end
            at = (_roll(flat, starts + end - self.block, self.block) >> self.down).astype(np.int64)
            np.minimum.at(self.shift, at, length - end)
        keys = self._keys(flat, starts)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def _keys(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        suffix = _roll(ids, starts + self.length - self.block, self.block)
        return suffix ^ (_roll(ids, starts, self.block) * _MULTIPLIER)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences in ``ids``: places of their first words, and the windows as indexes into ``starts``."""
        none = np.zeros(0, np.int64)
        if len(ids) < self.length:
            return none, none
        moves = self.shift[(_roll(ids, np.arange(len(ids) - self.block + 1), self.block) >> self.down).astype(np.int64)].tolist()
        seen, at, stop = [], self.length - self.block, len(moves)
        while at < stop:
            move = moves[at]
            if move:
                at += move
            else:
                seen.append(at)
                at += 1
        if not seen:
            return none, none
        first = np.array(seen, np.int64) - (self.length - self.block)
        keys = self._keys(ids, first)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        found, which = [none], [none]
        depth = 0
        while True:  # the bucket's windows, one of each bucket at a time
            live = np.flatnonzero(low + depth < high)
            if not len(live):
                return np.concatenate(found), np.concatenate(which)
            window = self.order[low[live] + depth]
            same = np.ones(len(live), bool)
            for k in range(self.length):
                same &= ids[first[live] + k] == self.flat[self.starts[window] + k]
            found.append(first[live[same]])
            which.append(window[same])
            depth += 1


class Searcher:
    """Windows of one shard: the numbers of its words, a group for each length, and the items of each distinct window."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        number = self.numbers.setdefault
        self.items = sorted({item for item, _ in pieces})
        place = {item: i for i, item in enumerate(self.items)}
        flat, owner, starts, lengths = [], [], [], []
        for item, parts in pieces:
            size, offset = min(window, len(parts)), len(flat)
            for word in parts:
                flat.append(number(word, len(self.numbers) + 1))
            count = len(parts) - size + 1 if parts else 0
            starts.extend(range(offset, offset + count))
            lengths.extend(repeat(size, count))
            owner.extend(repeat(place[item], count))
        flat, starts, lengths, owner = np.array(flat, np.int64), np.array(starts, np.int64), np.array(lengths, np.int64), np.array(owner, np.int64)
        self.groups = []
        for length in np.unique(lengths):
            mine = lengths == length
            table = flat[starts[mine][:, None] + np.arange(length)]
            _, first, klass = np.unique(table, axis=0, return_index=True, return_inverse=True)
            klass = klass.reshape(-1)
            pairs = np.unique(np.stack([klass, owner[mine]], 1), axis=0)  # items of each distinct window
            cut = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
            self.groups.append((Group(flat, starts[mine][first], int(length)), pairs[:, 1], cut))

    def scan(self, texts: list[bytes | None]) -> tuple[list, list, list, list]:
        """For each text the number of its words, the starts and stops of its hit stretches, and the items found."""
        get, ids, counts = self.numbers.get, [0], []
        for text in texts:
            parts = words(text)
            counts.append(len(parts))
            ids.extend(map(get, parts, repeat(0)))
            ids.append(0)  # the number of no item's word
        ids = np.array(ids, np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)]) + 1  # first word of each text
        edge = np.zeros(len(ids) + 1, np.int64)
        owners, owned = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for group, items, cut in self.groups:
            first, window = group.find(ids)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + group.length, -1)
            text = np.searchsorted(bounds, first, "right") - 1
            met = np.unique(text * len(group.starts) + window)  # a window counts once a text
            text, window = met // len(group.starts), met % len(group.starts)
            many = cut[window + 1] - cut[window]
            owners.append(np.repeat(text, many))
            owned.append(items[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(cut[window], many)])
        hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        turns = np.flatnonzero(hit[1:] != hit[:-1])
        starts, stops = turns[::2], turns[1::2]
        text = np.searchsorted(bounds, starts, "right") - 1
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        starts, stops = (starts - bounds[text]).tolist(), (stops - bounds[text]).tolist()
        pairs = np.unique(np.concatenate(owners) * max(len(self.items), 1) + np.concatenate(owned))
        rows, ranks = pairs // max(len(self.items), 1), pairs % max(len(self.items), 1)
        own = np.searchsorted(rows, np.arange(len(texts) + 1))
        return (counts, [starts[a:b] for a, b in zip(cuts, cuts[1:])], [stops[a:b] for a, b in zip(cuts, cuts[1:])],
                [[self.items[r] for r in ranks[a:b]] for a, b in zip(own, own[1:])])


def pieces(items: DataFrame, item_id: str, item_text: str, window: int, piece_words: int) -> DataFrame:
    """(item, body): words of the items joined by blanks, long items cut where no window is lost."""
    def cut(ids, texts):
        out = []
        for text in texts:
            parts = words(text)
            step = piece_words - window + 1
            out.append([b" ".join(parts[a:a + piece_words]).decode() for a in range(0, max(len(parts) - window + 1, 1), step)])
        return [ids, out]

    name = F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit(""))
    made = computed(items, [name, F.col(f"`{item_text}`").cast("binary")], [
        T.StructField("item", T.StringType()), T.StructField("bodies", T.ArrayType(T.StringType()))], lambda: cut, [])
    return made.select("item", F.explode("bodies").alias("body")).where("body <> ''").distinct()


def shards(found: DataFrame, shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Pieces in lists of about ``shard_words`` words, one list on the driver at a time."""
    held, size = [], 0
    for row in found.toLocalIterator():
        parts = row["body"].encode().split()
        if held and size + len(parts) > shard_words:
            yield held
            held, size = [], 0
        held.append((row["item"], parts))
        size += len(parts)
    yield held


FOUND = [T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())),
         T.StructField("stops", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]


def _scan(docs: DataFrame, text: str, held: list, window: int, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(held)  # at most SHARD_WORDS and one piece

    def make():
        searcher = Searcher(shared.value, window)

        def run(texts):
            columns, start, size = ([], [], [], []), 0, 0
            for i, body in enumerate([*texts, None]):
                if i == len(texts) or (i > start and size + len(body or b"") > STEP_BYTES):
                    for column, more in zip(columns, searcher.scan(texts[start:i])):
                        column.extend(more)
                    start, size = i, 0
                size += len(body or b"")
            return columns

        return run

    return computed(docs, [F.col(f"`{text}`").cast("binary")], FOUND, make, keep)


def find_items(docs: DataFrame, text: str, items: DataFrame, item_id: str = "item_id", item_text: str = "text",
               keep: list[str] | None = None, window: int = WINDOW, shard_words: int = SHARD_WORDS,
               piece_words: int = PIECE_WORDS) -> DataFrame:
    """Append where the whole texts hold windows of benchmark items.

    Adds ``n_words``, the disjoint hit stretches as word numbers ``starts`` and ``stops`` (exclusive), and ``items``, the ids
    of the items found as sorted strings. NULL and empty texts have no words and no hits; rows are neither merged nor
    dropped, repeated ones included. Items without words are never found, a NULL id reads as the empty string, and rows that
    share an id are one item. Columns of ``docs`` that are called like a new one are replaced; ``keep`` names those to carry.
    """
    names = {f.name for f in FOUND}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    parts = shards(pieces(items, item_id, item_text, window, piece_words), shard_words)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _scan(docs, text, first, window, keep)
    row = "__llm_row"
    rows = shared_table(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__llm_text"),
                                    F.monotonically_increasing_id().alias(row)))
    found = [_scan(rows, "__llm_text", held, window, [row]) for held in (first, second, *parts)]
    hits = found[0].where(F.size("items") > 0)
    for more in found[1:]:
        hits = hits.unionByName(more.where(F.size("items") > 0))
    merged = hits.groupBy(row).agg(  # one row a shard at most
        F.flatten(F.collect_list(F.arrays_zip("starts", "stops"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = _disjoint(F.array_sort("spans"))
    merged = merged.select(row, joined["starts"].alias("starts"), joined["stops"].alias("stops"), "items")
    counted = found[0].select(row, "n_words")
    empty = {"starts": "array<bigint>", "stops": "array<bigint>", "items": "array<string>"}
    out = rows.join(counted, row).join(merged, row, "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "n_words",
                      *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in empty.items()])


def _disjoint(spans: Column) -> Column:
    """Starts and stops of sorted spans after touching ones have been joined."""
    none = F.array().cast("array<bigint>")

    def add(state, span):
        fresh = F.size(state["stops"]) == 0
        last = F.element_at(state["stops"], -1)
        apart = fresh | (span["starts"] > last)
        stops = F.when(apart, F.concat(state["stops"], F.array(span["stops"]))).otherwise(
            F.concat(F.slice(state["stops"], 1, F.size(state["stops"]) - 1), F.array(F.greatest(last, span["stops"]))))
        return F.struct(F.when(apart, F.concat(state["starts"], F.array(span["starts"]))).otherwise(state["starts"]).alias("starts"),
                        stops.alias("stops"))

    return F.aggregate(spans, F.struct(none.alias("starts"), none.alias("stops")), add)

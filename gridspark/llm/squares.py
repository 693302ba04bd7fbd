"""Periodic runs by online dyadic square catching.

A stretch of period p is a range of places x with word[x] = word[x + p]; it makes a run of period p once it is p places
long, that is, once it holds a square. Whatever its place, a stretch of ``2**(k+1) - 1`` places covers a whole block of
``2**k`` words that begins at a multiple of ``2**k``. So a catcher stands at every such block that is complete: for each
lag of its level it waits for the block to come again that far on, by fingerprints, and stays for no longer than its largest
lag. A repeated block opens a comparison, which is carried backward over earlier words and then forward with
each word that is appended, until two words differ. A comparison that has grown to its lag is a square, and further
squares of the same lag merge into its run.

Words may be appended one by one or many at once; the comparisons of one call are made together in numpy. A level has
about twice as many pairs of a block and a lag as there are words, so all levels together take O(n log n).
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import computed

LEAST = 12  # words of the shortest run
STEP_BYTES = 1 << 20  # bytes of text that are searched at a time; a longer text is searched by itself
CELLS = 1 << 22  # pairs or words that one numpy step compares
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def level_of(lag: int, least: int = LEAST) -> int:
    """The largest k for which every stretch of this lag that makes a run covers a whole block of 2**k words."""
    return (max(lag, least - lag) + 1).bit_length() - 2


def spans(top: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(level, first lag, last lag) of all lags up to ``top``; from ``least`` on a level's lags are one range."""
    out, lag = [], 1
    while lag <= top:
        level = level_of(lag, least)
        last = min(top, (1 << (level + 2)) - 2) if lag >= least else lag
        if out and out[-1][0] == level and out[-1][2] == lag - 1:
            out[-1] = (level, out[-1][1], last)
        else:
            out.append((level, lag, last))
        lag = last + 1
    return out


class Catchers:
    """Words so far, fingerprints of all levels, and the comparisons of the squares that may still grow."""

    def __init__(self, longest: int, least: int = LEAST):
        """``longest`` bounds the words between two words that occur once, and with it the lags to look for."""
        self.least, self.words = least, np.zeros(0, np.int64)
        self.spans = spans(longest // 2, least)
        self.prints = [np.zeros(0, np.uint64) for _ in range(max((k for k, _, _ in self.spans), default=-1) + 1)]
        # Comparisons (lag, first place, place after the last): the closed ones are runs, the open ones reach the end.
        self.closed = np.zeros((0, 3), np.int64)
        self.open = np.zeros((0, 3), np.int64)

    def append(self, words: np.ndarray) -> None:
        old = len(self.words)
        self.words = np.concatenate([self.words, np.asarray(words, np.int64)])
        now, self.open = self.open, self.open[:0]
        self._keep(now[:, 0], now[:, 1], now[:, 2] + self._ahead(now[:, 0], now[:, 2]))
        for level in range(len(self.prints)):
            self._extend(level)
            for least, most in ((a, b) for k, a, b in self.spans if k == level):
                self._catch(level, least, most, old)

    def runs(self) -> np.ndarray:
        """(start, length, smallest period) of all runs so far, by start and period."""
        found = np.concatenate([self.closed, self.open])
        found = found[self._square(found)]
        start, length = found[:, 1], found[:, 2] - found[:, 1] + found[:, 0]
        order = np.lexsort((found[:, 0], length, start))
        start, length, lag = start[order], length[order], found[order, 0]
        # A multiple of a run's period spans the same words, so the least lag of equal spans is the period.
        fresh = np.ones(len(start), bool)
        fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        out = np.stack([start, length, lag], 1)[fresh]
        return out[np.lexsort((out[:, 2], out[:, 0]))]

    def _square(self, found: np.ndarray) -> np.ndarray:
        size = found[:, 2] - found[:, 1]
        return (size >= found[:, 0]) & (size + found[:, 0] >= self.least)

    def _keep(self, lag: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        found, grows = np.stack([lag, low, high], 1), high + lag == len(self.words)
        self.open = np.concatenate([self.open, found[grows]])
        done = found[~grows]
        self.closed = np.concatenate([self.closed, done[self._square(done)]])

    def _extend(self, level: int) -> None:
        """Fingerprints of all blocks of 2**level words that are complete now."""
        have, count = self.prints[level], len(self.words) - (1 << level) + 1
        if count <= len(have):
            return
        if level == 0:
            fresh = self.words[len(have):count].astype(np.uint64) * _A
        else:
            below, half = self.prints[level - 1], 1 << (level - 1)
            fresh = below[len(have):count] * _A + below[len(have) + half:count + half] * _B
        fresh ^= fresh >> np.uint64(31)
        self.prints[level] = np.concatenate([have, fresh]) if len(have) else fresh

    def _catch(self, level: int, least: int, most: int, old: int) -> None:
        """Open comparisons for the blocks that came again with the words since ``old``, at lags from least to most."""
        prints, size = self.prints[level], 1 << level
        fresh = max(0, old - size + 1)  # the first place whose block was completed by the new words
        if len(prints) <= fresh:
            return
        begin = -(-max(0, fresh - most) // size) * size
        blocks = np.arange(begin, max(begin, len(prints) - least), size)
        width = most - least + 1
        for at in range(0, len(blocks), max(1, CELLS // width)):
            rows = blocks[at:at + max(1, CELLS // width)]
            stop = min(len(prints), int(rows[-1]) + most + 1) if len(rows) else 0
            part = prints[rows[0] + least:stop] if len(rows) else prints[:0]
            whole = max(0, min(len(rows), (len(part) - width) // size + 1))
            hits = []
            if whole:
                view = np.lib.stride_tricks.as_strided(part, (whole, width), (size * part.itemsize, part.itemsize))
                hits.append(np.nonzero(view == prints[rows[:whole], None]))
            for r in range(whole, len(rows)):  # windows that the end of the text cuts short
                near = part[r * size:r * size + width]
                found = np.flatnonzero(near == prints[rows[r]])
                hits.append((np.full(len(found), r), found))
            block = rows[np.concatenate([h[0] for h in hits])] if hits else rows
            lag = np.concatenate([h[1] for h in hits]) + least if hits else rows
            late = block + lag >= fresh
            self._open(block[late], lag[late], size)

    def _open(self, block: np.ndarray, lag: np.ndarray, size: int) -> None:
        while len(block):
            fresh = ~self._known(block, lag, size)
            block, lag = block[fresh], lag[fresh]
            order = np.lexsort((block, lag))
            block, lag = block[order], lag[order]
            # Blocks side by side at one lag belong to one comparison.
            head = np.ones(len(block), bool)
            head[1:] = (lag[1:] != lag[:-1]) | (block[1:] != block[:-1] + size)
            first, lags = block[head], lag[head]
            high = first + self._ahead(lags, first)
            low = first - self._behind(lags, first)
            self._keep(lags, low, high)
            # Blocks that a comparison did not reach, for two fingerprints may agree by chance, open another one.
            reach = high[np.cumsum(head) - 1]
            rest = ~head & (block >= reach)
            block, lag = block[rest], lag[rest]

    def _known(self, block: np.ndarray, lag: np.ndarray, size: int) -> np.ndarray:
        """Pairs inside a comparison of their own lag, or inside a run whose period the block covers.

        Such a run has all squares in it at multiples of its period, and they span the same words.
        """
        known = np.concatenate([self.closed, self.open])
        if not len(known) or not len(block):
            return np.zeros(len(block), bool)
        short = known[self._square(known) & (known[:, 0] <= size)]
        out = np.zeros(len(block), bool)
        if len(short):
            short = short[np.argsort(short[:, 1], kind="stable")]
            reach = np.maximum.accumulate(short[:, 2] + short[:, 0])
            at = np.searchsorted(short[:, 1], block, "right") - 1
            out = (at >= 0) & (reach[np.maximum(at, 0)] >= block + lag + size)
        far = len(self.words) + 1
        mine = known[np.lexsort((known[:, 1], known[:, 0]))]
        at = np.searchsorted(mine[:, 0] * far + mine[:, 1], lag * far + block, "right") - 1
        near = mine[np.maximum(at, 0)]
        return out | ((at >= 0) & (near[:, 0] == lag) & (block < near[:, 2]))

    def _ahead(self, lag: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many places from each one on agree with the words ``lag`` later."""
        return self._agree(lag, place, 1, len(self.words) - lag - place)

    def _behind(self, lag: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many places before each one agree with the words ``lag`` later."""
        return self._agree(lag, place - 1, -1, place)

    def _agree(self, lag: np.ndarray, place: np.ndarray, way: int, room: np.ndarray) -> np.ndarray:
        out, live, width = np.zeros(len(lag), np.int64), np.flatnonzero(room > 0), 8
        while len(live):
            left = []
            for at in range(0, len(live), max(1, CELLS // width)):
                mine = live[at:at + max(1, CELLS // width)]
                offset = out[mine, None] + np.arange(width)
                inside = offset < room[mine, None]
                x = np.where(inside, place[mine, None] + way * offset, 0)
                differs = ~inside | (self.words[x] != self.words[np.where(inside, x + lag[mine, None], 0)])
                ends = differs.any(1)
                out[mine] += np.where(ends, differs.argmax(1), width)
                left.append(mine[~ends])
            live, width = np.concatenate(left), min(width * 2, CELLS)
        return out


def planted(parts: list, doc_id) -> list:
    """The words with a repeated stretch at the end where crc32 of the id, modulo 10, is 0; a NULL id plants none."""
    h, n = zlib.crc32(str(doc_id).encode()), len(parts)
    if doc_id is None or h % 10 or not n:
        return parts
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return parts[:a] + (parts[a:a + p] * ((n - a) // p + 1))[:n - a]


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Runs of each list of words; all lists are appended to one set of catchers, with a word of its own after each."""
    numbers: dict[bytes, int] = {}
    give, flat, bounds = numbers.setdefault, [], [0]
    for k, parts in enumerate(texts):
        flat.extend([give(w, len(numbers)) for w in parts])
        flat.append(-1 - k)
        bounds.append(len(flat))
    catchers = Catchers(max((len(p) for p in texts), default=0), least)
    catchers.append(np.array(flat, np.int64))
    runs = catchers.runs()
    cuts = np.searchsorted(runs[:, 0], bounds)
    return [runs[a:b] - [start, 0, 0] for a, b, start in zip(cuts, cuts[1:], bounds)]


def collapse(parts: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not len(runs):
        return parts
    edge = np.zeros(len(parts) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edge)[:-1] == 0
    return [w for w, k in zip(parts, keep.tolist()) if k]


RUNS = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("starts", "lengths", "periods")] + [
    T.StructField("collapsed", T.StringType())]


def periodic_runs(df: DataFrame, text: str, key: str | None = None, keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """Append the periodic runs of each whole text, as word numbers, and the text without the words that they repeat.

    Words are what blanks and control blanks (space, tab to carriage return) part; NULL and empty texts have none, hence
    no runs and an empty collapsed text. Runs are ordered by start, then period. With ``key`` the words of
    ``planted`` are taken in place of the text's own. Each row is searched by itself, repeated rows
    included; columns called like a new one are replaced, and ``keep`` names those to carry.
    """
    def make():
        def run(texts, keys=None):
            columns, start, size = ([], [], [], []), 0, 0
            for i, body in enumerate([*texts, None]):
                if i == len(texts) or (i > start and size + len(body or b"") > STEP_BYTES):
                    lists = [t.split() if t else [] for t in texts[start:i]]  # bytes part at space and \t to \r, only
                    if keys is not None:
                        lists = [planted(p, k) for p, k in zip(lists, keys[start:i])]
                    for parts, runs in zip(lists, find_runs(lists, least)):
                        for column, c in zip(columns, range(3)):
                            column.append(runs[:, c].tolist())
                        columns[3].append(b" ".join(collapse(parts, runs)).decode())
                    start, size = i, 0
                size += len(body or b"")
            return columns

        return run

    body = F.col(f"`{text}`").cast("binary")
    return computed(df, [body] + ([F.col(f"`{key}`").cast("string")] if key else []), RUNS, make, keep)


"""Periodic runs, benchmark words and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from gridspark.llm import chat_repair, squares, wu_manber
from gridspark.llm.queries import REGISTRY

ODD = [None, "", " ", "\n\n", "a", "a  b", "x" * 3000, "\x1c a\x0bb\x0cc\x85d", "a " * 5000, "É a É a É a É a É a É a É a É a"]


def brute_runs(words, least=squares.LEAST):
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        x = 0
        while x < n - p:
            if words[x] != words[x + p]:
                x += 1
                continue
            low = x
            while x < n - p and words[x] == words[x + p]:
                x += 1
            if x - low >= p and x - low + p >= least:
                out.setdefault((low, x - low + p), p)
    return sorted((s, n, p) for (s, n), p in out.items())


def random_words(draw, n):
    """Texts with squares: random over few words, repeats of a stretch with faults, Fibonacci words, one word only."""
    kind = draw.randrange(5)
    if kind == 0:
        return [draw.randrange(2) for _ in range(n)]
    if kind == 1:
        base = [draw.randrange(9) for _ in range(1 + draw.randrange(max(1, n // 2)))]
        out = (base * n)[:n]
        for _ in range(draw.randrange(4)):
            out[draw.randrange(n)] = 99
        return out
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    return [0] * n if kind == 3 else [draw.randrange(4) for _ in range(n // 2)] * 2


def test_runs_against_brute_force():
    draw = random.Random(1)
    for _ in range(150):
        words = random_words(draw, draw.choice([1, 2, 11, 12, 13, 25, 40, 100, 300]))
        least = draw.choice([2, 12])
        catchers = squares.Catchers(len(words), least)
        catchers.append(np.array(words))
        assert [tuple(r) for r in catchers.runs().tolist()] == brute_runs(words, least)


def test_words_may_come_one_by_one():
    draw = random.Random(2)
    for step in (1, 3, 17):
        words = random_words(draw, 120)
        catchers = squares.Catchers(len(words))
        for at in range(0, len(words), step):
            catchers.append(np.array(words[at:at + step]))
            assert [tuple(r) for r in catchers.runs().tolist()] == brute_runs(words[:at + step])


def test_texts_of_a_batch_do_not_meet(monkeypatch):
    texts = [[b"a", b"b"] * 8, [b"a", b"b"] * 9, [], [b"c"] * 12, [b"c"] * 11]
    assert [r.tolist() for r in squares.find_runs(texts)] == [[[0, 16, 2]], [[0, 18, 2]], [], [[0, 12, 1]], []]
    monkeypatch.setattr(squares, "CELLS", 8)
    assert [r.tolist() for r in squares.find_runs(texts)] == [[[0, 16, 2]], [[0, 18, 2]], [], [[0, 12, 1]], []]


def test_fingerprints_that_agree_by_chance(monkeypatch):
    draw = random.Random(3)
    monkeypatch.setattr(squares, "_A", np.uint64(0))  # every print is the same, so every block seems to come again
    monkeypatch.setattr(squares, "_B", np.uint64(0))
    for _ in range(20):
        words = random_words(draw, 60)
        catchers = squares.Catchers(len(words))
        catchers.append(np.array(words))
        assert [tuple(r) for r in catchers.runs().tolist()] == brute_runs(words)


def expected_runs(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words) if n < 2000 else [(0, n, 1)]
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with NULLs, odd texts, repeated rows, clashing extra columns, and benchmark passages."""
    draw = random.Random(5)
    root = str(tmp_path_factory.mktemp("tables"))
    vocabulary = ["the", "of", "Zwei", "é", "x1", "and", "to", "in"]
    item = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, item(draw.choice([1, 3, 9, 10, 11, 30]))) for i in range(30)] + [(7, item(12)), (None, "solo null item"), (90, None), (91, "-- !"), (91, "")]
    texts = ODD + [item(draw.randrange(200)) for _ in range(40)]
    texts += [item(5) + " " + draw.choice(items[:30])[1].upper() + "!" + item(7) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 20), (3, texts[3]), (11, texts[11])]
    spark.createDataFrame([(*r, 1, ["q"], 5) for r in rows], "doc_id long, text string, n_words int, starts array<string>, Periods int").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    chats = []
    for c in [*range(150), None]:
        for t in range(draw.randrange(14)):
            said = draw.choice(["Yes.", "No?", "cut off", "", " \t", "Yes.", None, "two\nlines. \x0b", f"n{t}!", "e. \x1c"])
            chats.append((c, draw.choice([t, t, t + 1, None]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), said, "k"))
    chats += chats[:40] + [(500, 0, "user", "x.", "k")] * 3 + [(501, None, "system", "x.", "k")] * 2
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string, letters string").write.parquet(f"{root}/conversations.parquet")
    return root, rows, items, chats


def test_op11(spark, folder):
    root, rows, _, _ = folder
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), *list(r)[1:]) for r in REGISTRY["op11_periodic_runs"].run(spark, root).collect())
    assert got == sorted(((d is None, d or 0), *expected_runs(d, t)) for d, t in rows)
    assert REGISTRY["op11_periodic_runs"].run(spark, root).columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_keep_other_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    out = squares.periodic_runs(docs, "text")
    assert out.columns == ["doc_id", "text", "n_words", "starts", "lengths", "periods", "collapsed"]
    row = out.where("doc_id = 8").collect()[0]
    assert (row.starts, row.lengths, row.periods, row.collapsed, row.n_words) == ([0], [5000], [1], "a", 1)
    assert squares.periodic_runs(docs.where("doc_id < 0"), "text").count() == 0


def expected_words(doc_id, text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item, body in items:
        parts = split(body)
        size = min(10, len(parts))
        for i, k in itertools.product(range(len(parts) - size + 1 if parts else 0), range(len(words) - size + 1)):
            if parts[i:i + size] == words[k:k + size]:
                hit |= set(range(k, k + size))
                found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_op12(spark, folder):
    root, rows, items, _ = folder
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), *list(r)[1:]) for r in REGISTRY["op12_benchmark_words"].run(spark, root).collect())
    assert got == sorted(((d is None, d or 0), *expected_words(d, t, items)) for d, t in rows)


def test_shards_and_pieces_change_nothing(spark, folder):
    root = folder[0]
    docs, items = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/benchmark.parquet")
    rows = lambda df: sorted(map(str, df.select("doc_id", "n_words", "starts", "stops", "items").collect()))
    whole = wu_manber.find_items(docs, "text", items)
    assert whole.columns == ["doc_id", "text", "Periods", "n_words", "starts", "stops", "items"]
    assert rows(wu_manber.find_items(docs, "text", items, shard_words=60, piece_words=12)) == rows(whole)
    assert wu_manber.find_items(docs.where("doc_id < 0"), "text", items).count() == 0
    assert all(r["items"] == [] and r["starts"] == [] for r in wu_manber.find_items(docs, "text", items.where("item_id < 0")).collect())


def test_long_blocks_skip_no_window(monkeypatch):
    draw = random.Random(6)
    monkeypatch.setattr(wu_manber, "PAIR_WINDOWS", 2)
    items = [(str(i), [b"%d" % draw.randrange(3) for _ in range(draw.choice([1, 2, 4, 10, 14]))]) for i in range(9)]
    texts = [" ".join(str(draw.randrange(3)) for _ in range(n)).encode() for n in (0, 1, 5, 40, 200)]
    counts, starts, stops, found = wu_manber.Searcher(items).scan(texts)
    pairs = [(i, " ".join(p.decode() for p in parts)) for i, parts in items]
    for k, text in enumerate(texts):
        n, hit, _, digest, _ = expected_words(k, text.decode(), pairs)
        assert (counts[k], sum(b - a for a, b in zip(starts[k], stops[k]))) == (n, hit)
        assert hashlib.sha256(",".join(found[k]).encode()).hexdigest() == digest


def expected_repair(rows):
    """Plain dynamic programming over (cost, letters, lines) for one conversation's damaged rows, in order."""
    seen, faults = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    moves = {("z", "s"): "s", ("z", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}

    def close(best):
        for _ in range(3):
            for (p, c), q in moves.items():
                if c != "s" and p in best:
                    cost, letters, lines = best[p]
                    new = (cost + 5, letters + "I", lines + [name[c] + ":"])
                    best[q] = min(best.get(q, new), new, key=lambda v: v[:2])
        return best

    best = close({"z": (0, "", [])})
    for (role, text), fault in zip(rows, faults):
        after = {}
        for p, (cost, letters, lines) in best.items():
            new = [(p, (cost + 2, letters + "D", lines))]
            if fault not in (1, 2):
                more = 5 * (fault == 3)
                for (q, c), to in moves.items():
                    if q == p and role[:1] == c:
                        new.append((to, (cost + more, letters + "K", lines + [f"{role}:{text}"])))
                    if q == p and c != "s":
                        new.append((to, (cost + 1 + more, letters + "R", lines + [f"{name[c]}:{text}"])))
            for q, v in new:
                after[q] = min(after.get(q, v), v, key=lambda w: w[:2])
        best = close(after)
    cost, letters, lines = min((best[q] for q in "za" if q in best), key=lambda v: v[:2])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return faults.count(1), faults.count(2), faults.count(3), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_op13(spark, folder):
    root, _, _, chats = folder
    want = {}
    for c in {r[0] for r in chats}:
        rows = []
        for conv, turn, role, text, _ in chats:
            if conv != c:
                continue
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = role if role is not None else " ", text if text is not None else " "
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            role = "user" if h == 4 else role
            rows += [(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text)] * (h != 0) * (1 + (h == 3))
        rows.sort()
        turns = [r[1] for r in rows if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        want[c] = (gaps, *expected_repair([(r[2], r[4]) for r in rows]))
    got = REGISTRY["op13_chat_repair"].run(spark, root)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and got.count() == len(want)


def test_block_length_changes_nothing():
    draw = np.random.default_rng(7)
    tables = [chat_repair.BlockTables(b) for b in (1, 2, 4)]
    assert len(tables[0].vectors) < 200
    for _ in range(200):
        symbols = draw.integers(0, chat_repair.SYMBOLS, draw.integers(0, 30))
        first, *others = [t.repair(symbols) for t in tables]
        assert all(o == first for o in others)


def test_repair_of_empty_tables(spark, folder):
    chats = spark.read.parquet(f"{folder[0]}/conversations.parquet")
    ids = chats.select(chats["conv_id"].alias("conv"))
    rows = chat_repair.damaged(chats.where("turn > 1000"), "conv_id", "turn", "role", "text")
    out = chat_repair.repair_conversations(rows, "conv", "turn", "role", "text", ids.where("conv in (1, 2)"))
    assert sorted(tuple(r) for r in out.collect()) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, 2)]
    assert chat_repair.repair_conversations(rows, "conv", "turn", "role", "text", ids.where("conv < 0")).count() == 0

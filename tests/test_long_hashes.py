"""Long hashes in pieces of a batch."""

import tracemalloc

import pandas as pd

from gridspark.udf import sql_functions


def plain(payload):
    h = 2166136261
    for b in payload:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def test_pieces_of_a_batch(monkeypatch):
    texts = [b"", b"a", None, b"foobar" * 9, b"xy" * 30, b"z" * 100]
    monkeypatch.setattr(sql_functions, "PIECE_BYTES", 64, raising=False)
    got = list(sql_functions.fnv1a32_large.func(iter([pd.Series(texts, index=[9, 4, 7, 1, 0, 3])])))[0]
    assert [None if v is pd.NA else int(v) for v in got] == [None if t is None else plain(t) for t in texts]


def test_memory_is_no_multiple_of_the_batch():
    batch = pd.Series([b"0123456789" * 100] * 64_000)  # 64 MB in all, one object
    tracemalloc.start()
    list(sql_functions.fnv1a32_large.func(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20

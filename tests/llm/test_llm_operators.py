"""Small fixtures and brute force for each operator: NULLs, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import (best_fit, chat_format, hnsw_dedup, language_id, license_scan, norm_topk, parity_join, prefix_bpe,
                           quality, site_lines)
from gridspark.llm.components import components
from gridspark.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "a  b", "x" * 3000, "Straße ÉÀ Σ İ 12 <|endoftext|> it's\n", "mm\t\x1c\x85 1"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)


def test_components_chain_and_repeats(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(3, 2), (90, 91), (7, 7), (None, 4)], "a long, b long")
    got = {r["node"]: r["component_id"] for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}
    assert components(edges.where("a < 0"), "a", "b").count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_counts_of_links_are_exact_in_blocks():
    draw = np.random.default_rng(8)
    linked, copies = draw.random((1300, 700)) < 0.1, draw.integers(1, 9, 700)
    assert (hnsw_dedup._copies_linked(linked, copies) == linked.astype(int) @ copies).all()
    assert (hnsw_dedup._copies_linked(linked.T, np.arange(1300)) == np.arange(1300) @ linked.astype(int)).all()


def test_typed_parts_and_the_loss_mask_read_back(spark):
    part = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
    t = lambda text: ("text", text, None, None, None, None, None)
    image, sound = ("image", None, "u", 28, 28, None, None), ("audio", None, "v", None, None, 1.0, None)
    rows = [(1, 0, "user", [t("see <|image:0|> "), image, t("|> and "), sound, t("")], "x"), (1, 1, "assistant", [t("a<|turn|>assistant\nb&lt;")], "x"),
            (1, 2, "user", [t("assistant")], "x"), (1, 3, "assistant", [t("É" * 5000)], "x"), (1, 4, "assistant", None, "x"), (None, 0, "assistant", [t("n")], "x"),
            (None, 0, "assistant", [t("n")], "x")]
    df = spark.createDataFrame(rows, f"c long, t long, r string, p array<{part}>, FORMATTED string")
    out = chat_format.format_conversations(df, "c", "t", "r", "p")
    got = {r["c"]: r for r in out.select("c", "formatted", chat_format.read_parts(F.col("formatted")).alias("turns"),
                                         chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    first = [tuple(p) for p in got[1]["turns"][0]["parts"]]
    assert first == [("text", None, "see <|image:0|> "), ("image", 1, None), ("text", None, "|> and "), ("audio", 3, None)]
    assert [p["text"] for p in got[1]["turns"][1]["parts"]] == ["a<|turn|>assistant\nb&lt;"] and got[1]["turns"][4]["parts"] == []
    assert got[1]["loss"] == "a<|turn|>assistant\nb&lt;" + "É" * 5000 and got[None]["loss"] == "nn"
    assert chat_format.format_conversations(df.where("t > 9"), "c", "t", "r", "p").count() == 0


def test_hnsw_against_brute_force(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(120, 16))
    x = np.concatenate([base, base[:40] + 0.05 * draw.normal(size=(40, 16)), base[:10],
                        base[0] + 0.12 * draw.normal(size=(150, 16))]).astype(np.float32)
    labels = [int(i % 3 == 0) if i < 160 else i % 2 for i in range(len(x))]
    rows = [(i, x[i].tolist(), labels[i]) for i in range(len(x))]
    bad = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, [1.0] * 16, None),
           (1005, [], 1), (1006, [1.0, 2.0], 1)]
    df = vectors(spark, rows + bad + rows[:5])
    for shard in (8192, 64):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
               for r in hnsw_dedup.near_duplicates(df, "vec_id", "embedding", "label", shard_rows=shard).collect()}
        y = x.astype(float)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        link = (y @ y.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels))
        np.fill_diagonal(link, False)
        least = np.arange(len(x))
        for _ in range(len(x)):
            least = np.minimum(least, np.where(link, least[None, :], len(x)).min(1))
        assert got == {**{i: (int(link[i].sum()), int(least[i]), bool(least[i] == i)) for i in range(len(x))},
                       **{b[0]: (0, b[0], True) for b in bad}}
    assert hnsw_dedup.near_duplicates(df.where("vec_id < 0"), "vec_id", "embedding", "label").count() == 0


def test_graph_recall():
    x = np.random.default_rng(1).normal(size=(700, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = hnsw_dedup.Graph.build(x).near(x, 48)
    truth = np.argsort(-(x @ x.T), 1)[:, :5]
    assert np.mean([len(set(t) & set(f)) / 5 for t, f in zip(truth, ids)]) >= 0.9


def test_chat_parts_and_round_trip(spark):
    part = chat_format.PART
    rows = spark.createDataFrame([
        (1, 1, "assistant", [("text", "a<|end|>\n&lt;[x]", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None)]),
        (1, 0, "us\ner", [("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 2)]),
        (2, None, None, None), (2, None, None, None)], f"c long, t long, r string, p array<{part}>")
    out = chat_format.format_conversations(rows, "c", "t", "r", "p").withColumn("back", chat_format.read_back(F.col("formatted")))
    got = {r["c"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [("us\ner", "<|audio:0|><|document:1|>".replace("<", "<")),
                                                               ("assistant", "a<|end|>\n&lt;[x]<|image:1|>")]
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [
        (0, "audio", "a.wav", 38), (0, "document", "d.pdf", 512), (1, "image", "i.png", 4)]
    span = got[1]["loss_spans"][0]
    assert got[1]["formatted"][span["start"]:][:span["length"]] == "a&lt;|end|>\n&amp;lt;&#91;x]<|image:1|>"
    assert got[2]["n_turns"] == 2 and got[1]["attachment_tokens"] == 554
    assert chat_format.format_conversations(rows.where("c < 0"), "c", "t", "r", "p").count() == 0


def test_quality_pairs_are_all_pairs(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(240, quality._FEATURES))
    y = (x[:, 0] - x[:, 1] + draw.normal(size=240) > 0).astype(int)
    table = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "y int, features array<double>")
    model = quality.fit_pairs(table)
    z = (x - x.mean(0)) / x.std(0)
    d = (z[y > 0][:, None] - z[y <= 0][None]).reshape(-1, quality._FEATURES)
    w = np.zeros(quality._FEATURES)
    for _ in range(30):  # the same Newton steps on each pair
        p = 1 / (1 + np.exp(-d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), d.T @ (1 - p) / len(d) - 1e-3 * w)
    assert np.abs(model.weights - w).max() < 2e-3
    ordered, bad = np.sort(((x - model.mean) / model.scale) @ model.weights), int((y <= 0).sum())
    assert abs(model.cut - (ordered[bad - 1] + ordered[bad]) / 2) < 1e-9


def test_quality_ranking(spark):
    random.seed(2)
    words = [f"word{i}" for i in range(300)]
    good = [" ".join(random.choices(words, k=60)) + "." for _ in range(60)]
    junk = [t.upper().replace(" ", "!! ") for t in good[:20]]
    df = docs(spark, good + junk)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(df, labels)
    got = quality.score_quality(df.withColumn("Score", F.lit("x")), model, "text").collect()
    assert all((r["score"] >= quality.CUT) == (r["doc_id"] < 60) for r in got) and len(got) == 80
    odd = quality.score_quality(docs(spark, ODD), model, "text", ["doc_id"]).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"]
    none = quality.fit_quality(df, labels.where("quality = 1"))
    assert {round(r["score"], 9) for r in quality.score_quality(df, none, "text").collect()} == {quality.CUT}


def test_language_id(spark):
    english, german = ["the cat and the house of the king"] * 3, ["der hund und das haus der königin"] * 3
    df = docs(spark, english + german).withColumn("lang", F.when(F.col("doc_id") < 3, "en").otherwise("de"))
    model = language_id.fit_languages(df)
    got = language_id.identify(docs(spark, ["the house", "das haus", "12 !", None, ""]), model, "text", ["doc_id"]).collect()
    assert [r["lang_pred"] for r in got] == ["en", "de", "und", "und", "und"] and [r["score"] for r in got][2:] == [0, 0, 0]
    # Brute force over single n-grams of one text.
    rows, starts, _ = language_id.hashed_grams(["ab"], 1 << 16)
    assert (rows < 1 << 16).sum(1).tolist() == [2, 3, 3] and starts.tolist() == [0]
    empty = language_id.fit_languages(df.where("doc_id < 0"))
    assert [r["lang_pred"] for r in language_id.identify(df, empty, "text").collect()] == ["und"] * 6


def test_license_scan(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License.", True), (2, "a/b/c/x.py", "code", False), (3, "a/b/y.py", None, False),
            (4, "z.py", "x\nLicensed under the Apache License, Version 2.0.\ny", False), (5, None, "", None),
            (6, "a/b/LICENSE", "All rights reserved.", True), (7, "q/r.py", "the of and under version", False)]
    got = {r["k"]: (r["own_license"], r["license"], r["inherited_from"]) for r in license_scan.scan_licenses(
        spark.createDataFrame(rows, "k long, path string, text string, flag boolean"), "k", "path", "text", "flag").collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "proprietary", "a/b"), 3: (None, "proprietary", "a/b"),
                   4: ("Apache-2.0", "Apache-2.0", None), 5: (None, None, None), 6: ("proprietary", "proprietary", None), 7: (None, None, None)}


@pytest.mark.parametrize("files", [40, 4000])
def test_license_words_weigh_by_their_files(spark, files):
    """Ordinary words beside a notice weigh little at any corpus size; words of one file weigh as much as they should."""
    schema = "k long, path string, text string, flag boolean"
    rows = [(i, f"d/{i}", "this file holds code", False) for i in range(files)]
    rows += [(files + i, f"d/n{i}", "All rights reserved.", False) for i in range(files // 150)]
    odd = {-1: "Copyright in this file: all rights reserved.", -2: "zyx qwv uvw zzy: all rights reserved", -3: "This file. This file."}
    rows += [(k, f"d/o{k}", t, False) for k, t in odd.items()]
    rows += [(-4, "d/c", "copyright in", False)] * (files // 20)
    got = license_scan.scan_licenses(spark.createDataFrame(rows, schema), "k", "path", "text", "flag").collect()
    assert len(got) == len(rows)
    found = {r["k"]: r for r in got if r["k"] < 0}
    assert [found[k]["own_license"] for k in (-1, -2, -3, -4)] == ["proprietary", None, None, None]
    words = [set(license_scan.terms(t)) for _, _, t, _ in rows]
    idf = {t: np.log((1 + len(rows)) / (1 + sum(t in w for w in words))) + 1 for t in license_scan.terms(odd[-1])}
    own = {t: w * w for t, w in idf.items()}
    want = np.sqrt(sum(own[t] for t in ("all", "rights", "reserved")) / sum(own.values()))
    assert abs(found[-1]["cosine"] - want) < 1e-9


def test_license_full_texts_and_tags(spark):
    """Whole licences with another holder, wrapped headers and SPDX tags; a long English text is no licence."""
    full = license_scan.full_texts()
    again = {n: "Copyright (c) 2021 Jane Roe\nAll rights reserved.\n\n" + "\n".join(t.split("\n")).replace("  ", " ") for n, t in full.items()}
    again["ISC"] = again["ISC"].replace("AND THE AUTHOR DISCLAIMS", "AND JANE ROE DISCLAIMS")
    prose = (license_scan.Path(license_scan.__file__).parents[2] / "README.md").read_text()
    other = {"see": ("# SPDX-License-Identifier: see below", None), "tag": ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
             "or": ("// SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "MIT OR Apache-2.0"), "prose": (prose, None),
             "lgpl": (" * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU Lesser "
                      "General Public License as published by\n * the Free Software Foundation; either version 3 of the License, or\n"
                      " * (at your option) any later version.\n *\n", "LGPL-3.0"),
             "cc": ("Licensed under CC BY 4.0", "CC-BY-4.0"), "epl": ("Licensed under the Eclipse Public License 2.0.", "EPL-2.0"),
             "bsd2": ("Copyright Jane Roe. All rights reserved.\n\n" + full["BSD-2-Clause"], "BSD-2-Clause")}
    rows = [(n, f"{n}/LICENSE", t, True) for n, t in again.items()] + [(n, f"{n}/x", t, n == "prose") for n, (t, _) in other.items()]
    want = {**{n: n for n in full}, **{n: name for n, (_, name) in other.items()}}
    for filler in (0, 300):
        df = spark.createDataFrame(rows + [(f"f{i}", f"f/{i}", "the and of code in this file", False) for i in range(filler)],
                                   "k string, path string, text string, flag boolean")
        got = license_scan.scan_licenses(df, "k", "path", "text", "flag").where("k not like 'f%'").collect()
        assert {r["k"]: r["own_license"] for r in got} == want


def test_prefix_bpe_and_decode(spark):
    path = vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = prefix_bpe.digests(docs(spark, ODD), "text", path, ["doc_id"]).collect()
    ids = prefix_bpe.encode(docs(spark, ODD), "text", path, ["doc_id"])
    back = {r["doc_id"]: r for r in prefix_bpe.decode(ids, "ids", path).collect()}
    for r in got:
        want = library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert back[r["doc_id"]]["ids"] == want and back[r["doc_id"]]["decoded"] == text
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = min((b for b in bins if b >= n), default=None)
        if room is not None:
            bins.remove(room)
        bins.append((capacity if room is None else room) - n)
    return sorted(bins)


def test_best_fit_equals_plain(spark):
    draw = random.Random(4)
    for capacity in (7, 50):
        lengths = [draw.randint(1, capacity) for _ in range(400)]
        df = spark.createDataFrame([(n, 1) for n in [*lengths, None, 0, capacity + 1]], "length int, Offset int")
        rows = best_fit.pack(df, capacity=capacity).collect()
        assert sum(r["sequence_id"] is None for r in rows) == 3
        used = {}
        for r in sorted((r for r in rows if r["sequence_id"] is not None), key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == used.get(r["sequence_id"], 0)
            used[r["sequence_id"]] = r["offset"] + r["length"]
        assert sorted(capacity - u for u in used.values()) == plain_best_fit(lengths, capacity)
    assert best_fit.pack(df.where("length < 0")).count() == 0


def test_token_pieces(spark):
    path = vocabulary("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = [*ODD, "lorem ipsum " * 3000]
    rows = best_fit.token_pieces(docs(spark, texts), "doc_id", "text", path).orderBy("doc_id", "piece").collect()
    at = {}
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert r["start"] == at.get(r["doc_id"], 0)
        at[r["doc_id"]] = r["start"] + r["length"]
        assert zlib.crc32(np.array(ids[r["start"]:at[r["doc_id"]]], "<u4").tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 2048
    assert at == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_site_lines(spark):
    rows = [(i, f"body {i}\nnav\n\nnav", "h", "keep") for i in range(9)] + [(9, None, "h", ""), (10, "nav", None, ""), (11, "nav", "one", "")]
    df = spark.createDataFrame(rows, "id long, text string, host string, Dropped string")
    got = {r["id"]: (r["text"], r["dropped"]) for r in site_lines.drop_boilerplate(df, "host", "text", dropped="dropped").collect()}
    assert got == {**{i: (f"body {i}\n", 2) for i in range(9)}, 9: (None, 0), 10: ("nav", 0), 11: ("nav", 0)}
    assert site_lines.drop_boilerplate(df.where("id < 0"), "host", "text").count() == 0


def test_norm_topk_against_brute_force(spark):
    draw = np.random.default_rng(8)
    x = (draw.normal(size=(300, 8)) * draw.choice([0.2, 1, 5], 300)[:, None]).astype(np.float32)
    x[200:220] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(500, None, 0), (550, [float("inf")] * 8, 0), (600, [1.0], 0), (None, [1.0] * 8, 0)]
    df = vectors(spark, rows + rows[:3])
    got = {}
    for r in norm_topk.top_products(df, "vec_id", "embedding", df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    want = {}
    for q in range(0, 300, 50):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
        want[q] = {k + 1: (int(i), int(s[i])) for k, i in enumerate(order)}
    assert got == want


def test_norm_topk_sends_only_buckets_that_are_long_enough(spark, monkeypatch):
    for name, size in (("BUCKET_ROWS", 32), ("QUERY_ROWS", 8), ("CELL_BUCKETS", 2), ("CELL_BLOCKS", 1)):
        monkeypatch.setattr(norm_topk, name, size)
    draw = np.random.default_rng(5)
    flat = np.abs(draw.normal(size=(1000, 6))) + 0.5
    flat /= np.linalg.norm(flat, axis=1)[:, None]
    skewed = flat * np.exp(draw.normal(size=1000) * 1.5)[:, None]
    met = {}
    for name, x in (("flat", flat), ("skewed", skewed), ("negative", np.concatenate([skewed[:950], -skewed[950:], np.zeros((1, 6))]))):
        df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))])
        asked = df.where("vec_id % 10 = 0")
        buckets = norm_topk.packed(df, "vec_id", "embedding", 256.0, 32)
        blocks = norm_topk._with_floors(norm_topk.packed(asked, "vec_id", "embedding", 256.0, 8), buckets, 5)
        met[name] = norm_topk.meets(blocks, buckets).count() / (buckets.count() * blocks.count())
        v = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in norm_topk.top_products(df, "vec_id", "embedding", asked).collect()}
        want = {}
        for q in range(0, len(x), 10):
            s = v @ v[q]
            order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:5]
            want.update({(q, k + 1): (int(i), int(s[i])) for k, i in enumerate(order)})
        assert got == want, name
    assert met["flat"] == 1 and met["skewed"] < 0.25  # no length tells unit vectors apart; long tails are not sent
    assert norm_topk.top_products(df.where("vec_id < 0"), "vec_id", "embedding", asked).count() == 0
    assert norm_topk.top_products(df, "vec_id", "embedding", asked.where("vec_id < 0")).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_parity_join_against_brute_force(spark):
    draw = random.Random(6)
    base = [[f"w{draw.randint(0, 500)}" for _ in range(n)] for n in (3, 4, 6, 9, 20, 60, 150, 400)]
    texts = list(ODD)
    for words in base:
        for edits in (0, 0, 1, 2, 4, 8):
            copy = list(words)
            for _ in range(edits):
                copy[draw.randrange(len(copy))] = f"e{draw.randint(0, 99)}"
            texts.append(" ".join(copy))
    texts += [" ".join(base[5] + [f"t{i}"] * (i % 7)) for i in range(40)]
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    least[i] = min(least[i], least[j])
    df = docs(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_components(df, "doc_id", "text").collect()}
    assert got == {i: (len(s), least[i]) for i, s in enumerate(sets)}
    assert parity_join.jaccard_components(df.where("doc_id < 0"), "doc_id", "text").count() == 0


def test_emissions_meet_and_sketches_bound():
    draw = np.random.default_rng(5)
    for _ in range(800):
        n = int(draw.choice([1, 2, 3, 5, 7, 8, 15, 16, 31, 43, 64, 100, 256, 341]))
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        i = int(np.ceil(n * draw.uniform(0.75, 1)))
        b = np.unique(np.concatenate([draw.permutation(a)[:i], draw.integers(0, 1 << 63, int(i / 0.75 - n), dtype=np.uint64)]))
        one, two = parity_join.emissions(a, 1), parity_join.emissions(b, 2)
        assert any(len(np.intersect1d(k, m)) >= max(p, q) for _, p, k in one for _, q, m in two)
        assert 7 * parity_join.distance(parity_join.bit_sketch(a), parity_join.bit_sketch(b)) <= len(a) + len(b)

"""Scans and gates on small files and frames."""

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gridspark.plans.masks import axis_steps, mask_counts
from gridspark.sinks import generations, packed, provenance
from gridspark.sources import catalogues, manifests, message_index, products, rasters, telemetry
from gridspark.sources.lines import numbered_lines

# Two wanted messages of a file of three; the first field repeats on another level.
WANTED = [("SNOD", "ground", "snow"), ("RH", "2 m", "humid")]
WHOLE = """1:0:d=1999:SNOD:ground:anl:
2:4096:d=1999:SNOD:1 m:anl:
3:5000:d=1999:RH:2 m:anl:
4:70000:d=1999:ALB:ground:anl:
"""


def test_message_index_ranges(spark, tmp_path):
    (tmp_path / "whole.idx").write_text(WHOLE)
    (tmp_path / "torn.idx").write_text(WHOLE.split("3:")[0])
    out = message_index.message_ranges(message_index.scan_index(spark, str(tmp_path)), WANTED)
    assert {(r.file_id.rsplit("/", 1)[1], r.name, r.start_byte, r.end_byte) for r in out.collect()} == {
        ("whole.idx", "snow", 0, 4095), ("whole.idx", "humid", 5000, 69_999)}


def test_repeated_message_keeps_its_last_match(spark):
    lines = [(1, i, f"{i}:{s}:d:{v}:level:anl:") for i, (v, s) in enumerate([("A", 0), ("A", 10), ("B", 30), ("Z", 50)])]
    out = message_index.message_ranges(spark.createDataFrame(lines, "file_id int, line_no int, text string"),
                                       [("A", "level", "a"), ("B", "level", "b")])
    assert {r.name: (r.start_byte, r.end_byte) for r in out.collect()} == {"a": (10, 29), "b": (30, 49)}


def test_count_mask(spark):
    rows = [("LW", -9999.0), ("LW", 255.0), ("LW", 253.0), ("LW", 120.0), ("VIS", 0.0), ("VIS", 1.0), ("VIS", 255.0), ("VIS", float("nan"))]
    out = mask_counts(spark.createDataFrame(rows, "product string, cnt double"))
    assert [r.cnt for r in out.collect()] == [None, None, 253.0, 120.0, None, 1.0, 255.0, None]


def test_point_product_rules(spark):
    good = [[x, y, 5] for x in range(4) for y in range(4)]
    docs = {"ok": good, "out of range": good[:-1] + [[0, 9, 101]], "repeated node": good[:-1] + [good[0]], "too few points": good[:3],
            "not triples": good[:-1] + [[1, 2]], "not whole degrees": good[:-1] + [[0.5, 8, 1]]}
    df = spark.createDataFrame([(k, json.dumps({"coordinates": v})) for k, v in docs.items()], "name string, doc string")
    out = products.scan_point_product(df, "name", "doc", min_points=16)
    assert all(r.name == r.rule for r in out.collect())
    assert products.explode_points(out, "name").count() == 16


def test_grid_gate(spark):
    def grid(name, change):
        return [(name, y, x, change(y, x)) for y in range(2) for x in range(3)]
    rows = grid("ok", lambda y, x: 1.0) + grid("not finite", lambda y, x: None if x == 2 else 1.0) \
        + grid("out of range", lambda y, x: 1e10) + grid("wrong geometry", lambda y, x: 1.0)[:-1]
    out = products.accept_grid(spark.createDataFrame(rows, "name string, y int, x int, v double"), ["name"], "v", 2, 3, 1e9)
    assert all(r.name == r.verdict for r in out.collect())


def test_element_sets(spark, tmp_path):
    l1, l2 = "1 25544U".ljust(69, "0"), "2 25544 ".ljust(69, "0")
    (tmp_path / "a.tle").write_text(f"\n STATION \n\n{l1}\n{l2}\n{l2}\n")
    (tmp_path / "b.tle").write_text(f"{l2}\n{l1[:-1]}\n{l2}\n")
    out = catalogues.scan_elements(catalogues.scan_lines(spark, str(tmp_path))).collect()
    assert [(r.object_id, r.name, r.l1, r.l2) for r in out] == [(25544, "STATION", l1, l2)]


def test_star_rows(spark):
    lines = ["# c", "", "1, 2, 3, 4, 5, 6", "1,2,3,4,5", "1,2,x,4,5,6", "1,2,3,4,5,6,7"]
    assert catalogues.parse_stars(spark.createDataFrame([(s,) for s in lines], "line string")).collect() == [(1, 2, 3, 4, 5, 6)]


def test_manifest_schema_is_closed(spark):
    docs = ['{"k": 1}', '{"k": 1, "z": 2}', "not json", '{"k": 1}' + " " * 20_000]
    rows = spark.createDataFrame([(d,) for d in docs], "j string")
    out = manifests.closed_json(rows, "j", "k bigint", ["k"], max_bytes=16_384).collect()
    assert [r.accepted for r in out] == [True, False, False, False] and out[1].unknown_keys == ["z"]
    assert [r.accepted for r in manifests.closed_json(rows, "j", "k bigint", ["k"]).collect()] == [True, False, False, True]


def test_status_line(spark):
    row = telemetry.scan_status(spark.createDataFrame([("fps=20 gpu_ms=2.5(star=0.1,earth=2.0) scene=day",)], "status string")).collect()[0]
    assert row.tags["fps"] == "20" and row.tags["scene"] == "day" and row.gpu_total == 2.5 and row.gpu_parts == {"star": "0.1", "earth": "2.0"}


def test_assets(spark):
    files = spark.createDataFrame([("a", "u", "1", 1), ("b", "u", "2", 1), ("c", "u", "3", 1)], "name string, url string, sha256 string, bytes int")
    want = spark.createDataFrame([("a", "u", "1"), ("b", "u", "9"), ("d", "u", "4")], "name string, url string, sha256 string")
    assert {r.name: r.verdict for r in products.verify_assets(files, want).collect()} == {"a": "ok", "b": "changed", "c": "unexpected", "d": "missing"}


def test_one_pixel_export(spark):
    cells = spark.createDataFrame([(0, 0, 0, 10, 20, 30, 42)], "grid_id int, y int, x int, r int, g int, b int, a int")
    assert bytes(packed.export_bgra(cells, ["r", "g", "b", "a"]).collect()[0].payload) == bytes([30, 20, 10, 42])
    assert bytes(packed.export_bgra(cells, ["r"]).collect()[0].payload) == bytes([10, 10, 10, 255])
    assert packed.sidecar(packed.export_bgra(cells, ["r"])).collect()[0].payload_bytes == 4


def test_publication_keeps_the_last_good(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    assert generations.current(spark, root) is None
    generations.publish(spark.range(3), root, "g1")
    assert generations.read_generation(spark, root).count() == 3
    with pytest.raises(Exception):
        generations.publish(spark.range(5).select(F.raise_error(F.lit("no")).alias("x")), root, "g2")
    assert generations.current(spark, root) == "g1" and generations.read_generation(spark, root).count() == 3

    def crash(*_):
        raise OSError("lost between the steps")
    with monkeypatch.context() as patch:  # the files are written, the entry is not
        patch.setattr(generations, "append", crash)
        with pytest.raises(OSError):
            generations.publish(spark.range(6), root, "g2")
    assert generations.current(spark, root) == "g1" and generations.read_generation(spark, root).count() == 3
    generations.publish(spark.range(7), root, "g2")
    assert generations.read_generation(spark, root).count() == 7
    assert generations.read_generation(spark, root, "g1").count() == 3
    generations.publish(spark.range(9), root, "g1")  # a repeated batch changes nothing
    assert generations.current(spark, root) == "g2" and generations.read_generation(spark, root, "g1").count() == 3


def test_two_writers_get_two_numbers_or_one_error(spark, tmp_path):
    root = str(tmp_path / "store")
    assert generations.append(spark, root, {"gen": "a"}, 0) == 0
    with pytest.raises(generations.Taken):
        generations.append(spark, root, {"gen": "b"}, 0)
    assert generations.entries(spark, root) == [{"gen": "a"}]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: generations.publish(spark.range(i), root, f"w{i}"), range(1, 5)))
    assert generations.numbers(spark, root) == [0, 1, 2, 3, 4]
    assert sorted(e["gen"] for e in generations.entries(spark, root)) == ["a", "w1", "w2", "w3", "w4"]


def test_long_files_are_numbered_across_byte_ranges(spark, tmp_path):
    """One long file is read by several tasks; its lines and message ranges are those of a plain walk."""
    lines = 120_000
    (tmp_path / "long.idx").write_text("".join("\n" if i % 1000 == 999 else f"{i}:{i * 10}:d=1999:{'SNOD' if i % 3 else 'ALB'}:lev {i % 7}:anl:\n" for i in range(lines)))
    (tmp_path / "short.idx").write_text("a\n\nb")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        out = numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = {(r.file_id.rsplit("/", 1)[1], r.line_no): r.line for r in out.collect()}
        assert len(got) == lines + 3 and got["long.idx", 999] == "" and got["short.idx", 1] == "" and got["short.idx", 2] == "b"
        assert all(got["long.idx", i].startswith(f"{i}:") for i in range(lines) if i % 1000 != 999)
        found = message_index.message_ranges(message_index.scan_index(spark, str(tmp_path / "long.idx")), [("SNOD", "lev 3", "snow")]).collect()
        last = max(i for i in range(lines - 1) if i % 1000 != 999 and i % 3 and i % 7 == 3)
        assert [(r.start_byte, r.end_byte) for r in found] == [(last * 10, last * 10 + (19 if last % 1000 == 998 else 9))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_hash_tree_finds_changed_and_moved_assets(spark):
    rows = [("p", f"n{i:04d}", f"{i:064x}", i) for i in range(300)] + [("q", "one", "0" * 64, 1), ("q", "one", "0" * 64, 1), ("r", None, None, None)]
    frame = lambda r: spark.createDataFrame(r, "pack string, name string, sha256 string, bytes long")
    tree = provenance.hash_tree(frame(rows), ["pack"])
    roots = {r.pack: r.digest for r in provenance.provenance(frame(rows), ["pack"], tree).collect()}
    level = [hashlib.sha256(f"{n}\n{s}\n{b}".encode()).hexdigest() for _, n, s, b in rows[:300]]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i:i + 16]).encode()).hexdigest() for i in range(0, len(level), 16)]
    assert roots["p"] == level[0] and len(roots) == 3
    leaves = tree.where("level = 0")
    paths = provenance.proofs(tree, ["pack"], leaves)
    digests = spark.createDataFrame(list(roots.items()), "pack string, digest string")
    checked = leaves.join(paths, ["pack", "pos"]).join(digests, "pack")
    assert checked.where(provenance.proven(F.col("hash"), F.col("path"), F.col("digest"))).count() == 303
    assert checked.where(provenance.proven(F.sha2("hash", 256), F.col("path"), F.col("digest"))).count() == 0
    changed = [*rows[:5], ("p", "n0005", "f" * 64, 5), *rows[6:]]
    moved = [*rows[:5], ("p", "x", rows[5][2], 5), *rows[6:]]
    for other in (changed, moved):
        new = {r.pack: r.digest for r in provenance.provenance(frame(other), ["pack"]).collect()}
        assert new["p"] != roots["p"] and new["q"] == roots["q"]


def test_raster_tiles(spark):
    tiles = spark.createDataFrame([(1, "w.200409.B2.raw", bytes(range(16))), (2, "w.A1.raw", b"x")], "key bigint, path string, payload binary")
    named = tiles.withColumn("name", rasters.tile_name("path"))
    out = rasters.decode_tiles(named, 2, 2, 4).collect()
    assert [(r.name, r.y, r.x, r.r, r.g, r.b) for r in out][:2] == [("B2", 0, 0, 0, 1, 2), ("B2", 0, 1, 4, 5, 6)]
    assert [r.key for r in rasters.bad_payloads(named, 2, 2, 4).collect()] == [2]


def test_axis_must_ascend(spark):
    axis = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.0, 1.0, 0.5])], "g int, i int, v double")
    assert [r.step for r in axis_steps(axis, ["g"], "i", "v").orderBy("i").collect()] == [None, 1.0, -0.5]


def test_sidecar_rules(spark):
    base = {"schema_version": 1, "asset": "panorama", "pixel_format": "bgra8", "color_space": "srgb", "origin": "top_left", "width": 8, "height": 4,
            "rgb_filter": "linear-light-srgb-v1", "row_stride_bytes": 32, "payload_bytes": 128, "left_lon": -180, "top_lat": 90}
    cases = {"ok": {}, "version": {"schema_version": 2}, "asset": {"asset": "x"}, "pixel format": {"pixel_format": "r8"}, "origin": {"origin": "bottom"},
             "filter": {"rgb_filter": "none"}, "stride": {"row_stride_bytes": 31}, "payload size": {"payload_bytes": 1},
             "not 2:1": {"height": 3, "payload_bytes": 96}, "orientation": {"left_lon": 0}}
    for rule, change in cases.items():
        row = {**base, **change}
        df = spark.createDataFrame([tuple(row.values())], list(row))
        assert df.select(manifests.sidecar_rule(df, "panorama", panorama=True).alias("r")).collect()[0].r == rule

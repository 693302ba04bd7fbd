"""The pipeline on the smallest tables: schemas, stage by stage decisions, and whole packing."""

import random

import corpus_pipeline
from gridspark.llm.columns import shared_table
from gridspark.llm import parity_join

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    first = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, shared_table(stage(spark, docs, FOLDER))
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() <= before.count()
        if name == "quality":
            kept = {r["doc_id"] for r in docs.collect()}
            assert all((d in kept) == bool(q) for d, q in labels.items() if d in first)
    found = parity_join.jaccard_components(docs, "doc_id", "text").collect()
    assert all(r["component_id"] == r["doc_id"] for r in found)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    sizes = {}
    for r in packed:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert max(sizes.values()) <= 2048


def test_one_row_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(7, text)] * 30 + [(5, text + " end")] * 3 + [(None, text)] * 4 + [(None, other)] * 5 + [(9, "alone here"), (None, None), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(got, key=str) == sorted([(5, text + " end"), (None, other), (9, "alone here"), (None, None), (None, None)], key=str)


FOREIGN = [
    "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью.",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli "
    "uni verso gli altri in spirito di fratellanza."]


def test_languages_never_seen_go(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    docs = shared_table(corpus_pipeline.keep_quality(spark, docs, FOLDER))
    draw = random.Random(1)
    noise = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(100))
    foreign = [(-1 - i, t, None, "s", len(t)) for i, t in enumerate([*FOREIGN, FOREIGN[0] * 20, noise])]
    both = docs.unionByName(spark.createDataFrame(foreign, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, both, FOLDER).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}

"""The pipeline's stages against plain versions of their decisions, on edge cases and on real rows."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from riskkit.llm import sentence_pieces as sp
from riskkit.llm import simhash_groups as sim
from riskkit.llm import source_mix as sm
from riskkit.llm import suffix_dedup as suf

SF = "/root/testdata/sf0.001"


def test_stages_are_the_five_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "repeated_passages", "source_mix", "sentence_pieces"]


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES[:-1]], ids=[n for n, _ in cp.STAGES[:-1]])
def test_columns_edges_and_empty_tables(spark, edge_docs, clashing, stage):
    docs = clashing.withColumn("n_chars", F.length("text").cast("long"))
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()} and all(r.fp == "x" for r in rows)
    none = stage(spark, docs.filter("false"), SF)
    assert none.columns == docs.columns and none.count() == 0


def test_near_duplicates_keep_one_of_each_group(spark, edge_docs):
    rows = cp.keep_one_of_each_group(spark, edge_docs, SF).collect()
    groups = sim.near_duplicate_groups(edge_docs).collect()
    assert len(rows) == len({g.root for g in groups})
    assert {r.doc_id for r in rows if r.doc_id is not None} == {g.component_id for g in groups if g.component_id is not None}


def test_unrelated_texts_of_one_id_all_stay(spark):
    texts = [f"{w} " * 3 + " ".join(f"{w}{i}{k}" for k in range(40)) for i, w in enumerate(["river", "stone", "winter", "garden", "letter"])]
    a, b, c, d, e = texts
    rows = [(1, a), (1, b), (1, b), (2, a), (2, c), (3, b), (None, a), (None, d), (None, d), (None, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in cp.keep_one_of_each_group(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (2, c), (None, d), (None, e)], key=str)


def test_repeats_are_cut_from_the_texts(spark, edge_docs):
    docs = edge_docs.withColumn("n_chars", F.lit(-1).cast("long")).dropDuplicates()
    rows = cp.cut_repeats(spark, docs, SF).collect()
    want = {(r.doc_id, r.kept.decode("utf-8", "ignore")) for r in suf.remove_repeats(docs).collect() if r.kept or not r.n_removed}
    assert {(r.doc_id, r.text) for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_the_mix_repeats_documents(spark, real_docs):
    rows = cp.take_mix(spark, real_docs, SF).groupBy("doc_id").count().collect()
    want = {r.doc_id: (2 * r.taken + r["size"]) // (2 * r["size"]) for r in sm.mix(real_docs).collect() if r["size"]}
    assert {r.doc_id: r["count"] for r in rows} == {d: n for d, n in want.items() if n}


def test_whole_run(spark):
    rows = cp.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for _, stage in cp.STAGES[:4]:
        step = spark.createDataFrame(stage(spark, step, SF).collect(), docs.schema)
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    want = sorted((r.doc_id, library.encode(r.text)) for r in step.collect())
    assert want and sorted((r.doc_id, r.ids) for r in rows) == want
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    assert len(good & {r.doc_id for r in rows}) <= 0.2 * len(good) + 1


#: Names that the stages and the operators below them use for themselves, or once did.
OWN_NAMES = ["row", "key", "own", "unnamed", "times", "whole", "kept", "n_removed", "got", "held", "first", "_id", "_row", "_unnamed", "_key", "_n",
             "_size", "_taken", "_salt", "decoded", "fp", "root", "component_id", "size", "taken", "target", "score", "h", "s", "ord", "place", "a.b"]


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_other_columns_keep_their_values(spark, edge_docs, stage):
    docs = edge_docs.withColumn("n_chars", F.length("text").cast("long"))
    mark = F.xxhash64("doc_id", "text", "lang", "source").cast("string")
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), mark).alias(n) for n in OWN_NAMES])
    home = {r["row"].split(" ")[1]: (r.doc_id, r.lang, r.source) for r in docs.collect()}
    out = stage(spark, docs, SF)
    assert set(OWN_NAMES) <= set(out.columns)
    rows = out.collect()
    assert rows
    for r in rows:
        marks = {r[n].removeprefix(f"{n} ") for n in OWN_NAMES}
        assert len(marks) == 1 and home[marks.pop()] == (r.doc_id, r.lang, r.source)

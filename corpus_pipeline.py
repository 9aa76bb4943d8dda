"""The corpus pipeline: quality, near duplicates, repeated passages, source mix, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of ``documents`` (and any others that came along).

Rows of a null id or text are documents like others; an empty table gives an
empty table.  Rows that repeat an id are documents of their own in the second
stage, which keeps one row of each group; later stages see what it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskkit.llm.folds import in_fold
from riskkit.llm.quality import HELD_OUT, fit_quality
from riskkit.llm.sentence_pieces import PieceModel, checked
from riskkit.llm.simhash_groups import near_duplicate_groups
from riskkit.llm.source_mix import mix
from riskkit.llm.storage import written
from riskkit.llm.suffix_dedup import remove_repeats

LEAST_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents, scores at 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality")
    model = fit_quality(docs.select("doc_id", "text"), labels.filter(~in_fold(F.col("doc_id"), *HELD_OUT)))
    return docs.filter(model.score(F.col("text")) >= LEAST_SCORE)


def _whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct: whatever they are called, they meet no name used here."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every SimHash group (3-word shingles, 2 bits) one row: of the smallest id, null last, the one with the least hash of its columns."""
    own = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    unnamed, key = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    groups = near_duplicate_groups(docs.select("doc_id", "text", unnamed.alias("unnamed"), own.alias("own")), shingle=3, max_bits=2, also=("unnamed", "own"))
    first = groups.groupBy("root").agg(F.min(F.struct("unnamed", "doc_id", "own")).alias("first"))
    # rows of one hash have one text, so one group; its id is compared too
    kept = written(first.select("first.own", F.coalesce("first.doc_id", F.lit(0).cast("long")).alias("key"), "first.unnamed"), "pipeline-groups")
    rows = docs.select(_whole(docs).alias("row"), own.alias("own"), key.alias("key"), unnamed.alias("unnamed"))
    return rows.join(kept, ["own", "key", "unnamed"], "left_semi").dropDuplicates(["own", "key", "unnamed"]).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their 100-byte repeats, n_chars to match; a document that was nothing but repeats goes."""
    kept = remove_repeats(docs.select("doc_id", "text", _whole(docs).alias("whole")), length=100, as_text=True)
    left = kept.filter((F.col("n_removed") == 0) | (F.col("kept") != ""))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[(new[c] if c in new else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the words taken over the words held, rounded.

    Rows that repeat an id share alike in what is taken; documents without words are not taken.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256)))
    took = mix(docs.select(key.alias("key"), "text", "source"), id_col="key").groupBy(F.col("doc_id").alias("key")).agg(
        F.sum("size").alias("held"), F.sum("taken").alias("got"))
    times = took.filter("2 * got >= held AND held > 0").select("key", F.expr("(2 * got + held) div (2 * held)").alias("times"))
    rows = docs.select(_whole(docs).alias("row"), key.alias("key")).join(times, "key")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, the digest of what they decode to, and whether that is the document's text."""
    return checked(docs, PieceModel.load())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("repeated_passages", cut_repeats),
    ("source_mix", take_mix),
    ("sentence_pieces", encode),
]

#: SQL cannot express a trained classifier, XXH64 or a tokenizer; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Filter interaction audit: truth-table survival words and carry-save positional popcounts.

Five filters A to E judge every document.  The set of filters that it fails
decides which of the 32 subsets of filters it survives: a document's survival
word has bit ``S`` set when none of the filters of subset ``S`` fails it, which
is the bitwise "and" of one truth-table constant per failed filter.  How many
documents of a part and label survive each subset is then a positional popcount
of their words, added up here by carry-save adders (three words in, a sum and a
carry out, bit by bit), and every figure of every order of the filters is a
difference of two of those 32 counts.

Filter E (an identical text under a smaller id, anywhere in the table) compares
SHA-256 digests: the smallest id of each digest is a combined minimum, and its
look-up is salted, so a text that a third of all documents share spreads out.
Texts are read once; a table of some sixty bytes a document is written and
used from there on.

Defined results: a null text is empty (it fails A alone, and E if repeated); a
null id is neither smaller nor larger than any, so it never fails E and fails
nobody else; rows that repeat an id and text are no copies of each other under
E, as neither id is smaller; a null part is the empty string, like an empty
one; of several labels of an id the largest counts, a null label is none; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, table
from .salted import look_up
from .storage import written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Bit S of the i-th constant is set when subset S lacks filter i.
LACKS = [sum(1 << s for s in range(SUBSETS) if not s >> i & 1) for i in range(len(FILTERS))]
LABELS = ("quality", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails the filters A to D, which look at nothing but the text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < 200,
            "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
            "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
            "D": F.length(text) > F.length(F.translate(text, "#$%&*|", ""))}


def survival_word(fails: dict[str, Column]) -> Column:
    """The 32-bit word (as a long) of the subsets that a document survives."""
    word = F.lit((1 << SUBSETS) - 1).cast("long")
    for name, lacks in zip(FILTERS, LACKS, strict=True):
        word = word.bitwiseAND(F.when(fails[name], F.lit(lacks).cast("long")).otherwise(F.lit((1 << SUBSETS) - 1).cast("long")))
    return word


def survival_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, quality, toxic, word) of every document."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
                       *[f.alias(f"fails_{k}") for k, f in failures(text).items()])
    marks = written(read, "filter-marks")
    first = (marks.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").drop("n"))
    best = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in LABELS])
    # both look-ups read the written marks, whose rows lie still
    seen = written(look_up(marks, ["digest"], first).drop("digest"), "filter-copies")
    known = look_up(seen, ["doc_id"], best)
    fails = {k: F.col(f"fails_{k}") for k in "ABCD"} | {"E": F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))}
    return known.select("part", *[F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in LABELS], survival_word(fails).alias("word"))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set, by carry-save adders.

    Words of one weight are added three at a time, without carries between
    positions: the "exclusive or" stays at that weight, the majority goes on at
    twice the weight.  At most two words are left at each weight in the end.
    """
    level, counts, weight = words.astype(np.uint32), np.zeros(SUBSETS, np.int64), 1
    places = np.arange(SUBSETS, dtype=np.uint32)
    while len(level):
        carries = []
        while len(level) >= 3:
            k = len(level) // 3
            a, b, c = level[:k], level[k:2 * k], level[2 * k:3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * k:]])
        for word in level:
            counts += weight * (word >> places & np.uint32(1)).astype(np.int64)
        level, weight = np.concatenate(carries) if carries else level[:0], weight * 2
    return counts


def survivors(words: DataFrame) -> DataFrame:
    """(part, quality, toxic, s0 .. s31): documents that survive each subset of the filters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").dictionary_encode()
            label = np.array(batch.column("quality")).astype(np.int64) * 2 + np.array(batch.column("toxic"))
            group = np.array(part.indices).astype(np.int64) * 4 + label
            order = np.argsort(group, kind="stable")
            word, ids = np.array(batch.column("word")).astype(np.uint32)[order], group[order]
            kinds, at = np.unique(ids, return_index=True)
            counts = [positional_popcount(w) for w in np.split(word, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.dictionary.take(pa.array(kinds // 4)), pa.array((kinds // 2 % 2).astype(bool)), pa.array((kinds % 2).astype(bool)),
                 *[pa.array(c) for c in np.stack(counts, axis=1)]], names=["part", *LABELS, *[f"s{i}" for i in range(SUBSETS)]])

    schema = "part string, quality boolean, toxic boolean, " + ", ".join(f"s{i} long" for i in range(SUBSETS))
    return words.mapInArrow(run, schema).groupBy("part", *LABELS).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(SUBSETS)])


def _bits(letters: str) -> int:
    return sum(1 << FILTERS.index(c) for c in letters)


def _steps() -> list[tuple[str, int, int, int, int]]:
    """(order, step, filters before, filters with this one, this filter) of all orders."""
    return [("".join(order), k + 1, _bits(order[:k]), _bits(order[:k + 1]), _bits(order[k]))
            for order in permutations(FILTERS) for k in range(len(FILTERS))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter does at every step of every order, per part; see ``op13_filter_audit`` for the columns."""
    by = survivors(survival_words(docs, labels))
    n = len(FILTERS)
    only = {c: F.array(*[F.sum(F.when(F.col(c), F.col(f"s{i}")).otherwise(0)) for i in range(SUBSETS)]).alias(f"_{c}") for c in LABELS}
    parts = by.groupBy("part").agg(F.array(*[F.sum(f"s{i}") for i in range(SUBSETS)]).alias("_all"), *only.values())
    # every order counts a filter's removals after the set of filters before it: |set|! (4 - |set|)! orders share one
    total = [sum((F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) * (F.col("_all")[s] - F.col("_all")[s | 1 << i])
                  for s in range(SUBSETS) if not s >> i & 1), F.lit(0).cast("long")) for i in range(n)]
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(f).alias("f"),
                               F.lit(FILTERS.index(o[k - 1])).alias("i")) for o, k, a, b, f in _steps()])
    rows = parts.withColumn("_total", F.array(*total)).withColumn("_step", F.explode(steps))
    at = lambda counts, field: F.element_at(F.col(counts), F.col(f"_step.{field}") + 1)
    removed = at("_all", "a") - at("_all", "b")
    whole = SUBSETS - 1
    return rows.select(
        "part", F.col("_step.filter_order").alias("filter_order"), F.col("_step.step").alias("step"), at("_all", "b").alias("kept"),
        removed.alias("removed"), (F.col("_all")[0] - at("_all", "f") - removed).alias("redundant"),
        (F.element_at("_all", F.lit(whole + 1) - F.col("_step.f")) - F.col("_all")[whole]).alias("unique_fails"),
        (at("_quality", "a") - at("_quality", "b")).alias("good_lost"), (at("_toxic", "a") - at("_toxic", "b")).alias("toxic_lost"),
        F.element_at("_total", F.col("_step.i") + 1).alias("shapley"))


_SQL = r"""
WITH l AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT t.part, coalesce(l.quality, 0) AS q, coalesce(l.toxic, 0) AS x,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
         + 8 * (regexp_matches(text, '[#$%&*|]'))::INT
         + 16 * coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)::INT AS m
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), s AS (
  SELECT part, b.s, count(*) FILTER (m & b.s = 0) AS n, count(*) FILTER (m & b.s = 0 AND q = 1) AS nq,
         count(*) FILTER (m & b.s = 0 AND x = 1) AS nx
  FROM f, range(32) b(s) GROUP BY part, b.s
), o AS (
  SELECT a.i AS c1, b.i AS c2, c.i AS c3, d.i AS c4, e.i AS c5
  FROM range(5) a(i), range(5) b(i), range(5) c(i), range(5) d(i), range(5) e(i)
  WHERE (1 << a.i) + (1 << b.i) + (1 << c.i) + (1 << d.i) + (1 << e.i) = 31
    AND len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), p AS (
  SELECT array_to_string(list_transform([c1, c2, c3, c4, c5], lambda v: chr((65 + v)::INT)), '') AS filter_order, k.k::INT AS step,
         [c1, c2, c3, c4, c5][k.k] AS i,
         list_sum(list_transform([c1, c2, c3, c4, c5][1:k.k - 1], lambda v: 1 << v)) AS before
  FROM o, range(1, 6) k(k)
), r AS (
  SELECT a.part, p.filter_order, p.step, p.i, b.n AS kept, a.n - b.n AS removed, a.nq - b.nq AS good_lost, a.nx - b.nx AS toxic_lost,
         z.n - g.n AS fails, u.n - v.n AS unique_fails
  FROM p JOIN s a ON a.s = coalesce(p.before, 0) JOIN s b ON b.part = a.part AND b.s = a.s + (1 << p.i)
  JOIN s z ON z.part = a.part AND z.s = 0 JOIN s g ON g.part = a.part AND g.s = (1 << p.i)
  JOIN s u ON u.part = a.part AND u.s = 31 - (1 << p.i) JOIN s v ON v.part = a.part AND v.s = 31
)
SELECT part, filter_order, step, kept, removed, fails - removed AS redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM r
"""


@query("op13_filter_audit", _SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))

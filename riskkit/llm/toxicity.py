"""Toxicity by multiple-instance learning: sentences judged, documents labelled.

A document is a bag of sentences: runs of words between full stops, exclamation
and question marks and line ends, cut after ``RUN`` words where none comes.  A
sentence's log-odds of being toxic are a bias plus the weights of its different
telling words; a document is toxic unless all its sentences are clean
(noisy-or), with a leak for documents that no sentence explains:

    P = 1 - (1 - leak) * product over telling sentences of (1 - p)

Only document labels are given; weights, bias and leak maximise their
likelihood.  A sentence without a telling word says nothing, so a long document
is not suspect for its length.  The telling words are chosen by how unevenly
toxic and clean documents hold them (the G statistic of their document counts,
added up in Spark).  ``locate`` returns the offending sentences.

The model is fitted on at most ``max_rows`` labelled documents, those with the
smallest hashes of their ids, one row per id, leaving out texts of more than
``max_bytes``; it keeps at most ``vocabulary`` words by 64-bit hash.  These
bounds are parameters of ``fit_toxicity``.  Scoring reads whole texts, long
ones piece by piece, so a task's memory does not grow with a text's length.

Defined results: null and empty texts, and texts without a telling word, score
the leak; a label row without a verdict is ignored, of several for one id the
largest counts; with no labels every score is 0, with one class the share of
label 1; rows that repeat are scored one by one; an empty table gives no rows;
other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import CHUNK_BYTES, chunks, lower, prefix_sums, runs, slices, span_hashes, text_bytes
from .catalog import query, table
from .folds import in_fold
from .storage import dropped, written

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
RUN = 32  # words of a sentence at most


def pieces(data: np.ndarray, bounds: np.ndarray, limit: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts with long ones cut at sentence ends, and the text that each piece belongs to.

    A piece holds at most ``limit`` bytes; where it has no sentence end it is cut
    before a word, and where it is one word, within it.
    """
    cuts, owner = [0], []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        while b - a > limit:
            window = data[a:a + limit]
            ends = np.flatnonzero(_END[window])
            if not len(ends):
                ends = np.flatnonzero(~_LETTER[window])
            a += int(ends[-1]) + 1 if len(ends) else limit
            cuts.append(a)
            owner.append(i)
        cuts.append(b)
        owner.append(i)
    return np.array(cuts, np.int64), np.array(owner, np.int64)


@dataclass(frozen=True)
class Sentences:
    """The words of some texts, and the sentence (numbered over all texts) that each is in."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    sentence: np.ndarray  # of every word
    text: np.ndarray  # of every word

    @staticmethod
    def of(data: np.ndarray, bounds: np.ndarray) -> Sentences:
        small = lower(data)
        start, end = runs(_LETTER[small], bounds)
        text = np.searchsorted(bounds, start, "right") - 1
        if not len(start):
            return Sentences(start, end, np.zeros(0, np.uint64), np.zeros(0, np.int64), text)
        stops = np.cumsum(_END[small])[start]
        new = np.concatenate(([True], (stops[1:] != stops[:-1]) | (text[1:] != text[:-1])))
        place = np.arange(len(start))
        place -= np.maximum.accumulate(np.where(new, place, 0))
        return Sentences(start, end, span_hashes(prefix_sums(small), start, end), np.cumsum(new | (place % RUN == 0)) - 1, text)

    def told(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, row of ``known``) of every telling word, once for each sentence; ``known`` is sorted."""
        if not len(known) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.minimum(np.searchsorted(known, self.hashes), len(known) - 1)
        hit = known[row] == self.hashes
        pair = np.unique(self.sentence[hit] * len(known) + row[hit])
        return pair // len(known), pair % len(known)


def _softplus(z: np.ndarray | float) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass(frozen=True)
class ToxicityModel:
    """Hashes of the telling words (sorted) and their weights, bias, and log-odds of the leak (``None``: ``prior`` alone)."""

    known: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    leak: float | None = None
    prior: float = 0.0

    def sentences(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the telling sentences and their log-odds."""
        sentence, row = s.told(self.known)
        ids, at = np.unique(sentence, return_inverse=True)
        return ids, self.bias + np.bincount(at, self.weights[row], len(ids)) if len(ids) else np.zeros(0)

    def judge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of every text, and of its sentences: rows of (text, first byte, last byte, log-odds)."""
        n = len(bounds) - 1
        if self.leak is None:
            return np.full(n, self.prior), np.zeros((0, 4))
        clean, found = np.zeros(n), [np.zeros((0, 4))]
        cuts, owner = pieces(data, bounds)
        for i, j in slices(np.diff(cuts), CHUNK_BYTES):
            a = cuts[i]
            s = Sentences.of(data[a:cuts[j]], cuts[i:j + 1] - a)
            ids, z = self.sentences(s)
            first, last = np.searchsorted(s.sentence, ids), np.searchsorted(s.sentence, ids, "right") - 1
            text = owner[i:j][s.text[first]]
            clean += np.bincount(text, _softplus(z), n)
            found.append(np.stack([text, a + s.start[first], a + s.end[last], z], axis=1))
        return -np.expm1(-_softplus(self.leak) - clean), np.concatenate(found)

    def score(self, text: Column) -> Column:
        """Struct of score, offending (sentences of at least even odds) and the worst sentence: its first character (from 0), length and score."""
        kind = "score double, offending int, worst_start int, worst_chars int, worst_score double"
        names = [f.split()[0] for f in kind.split(", ")]

        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in texts:
                parts = [self._rows(p.column("text")) for p in chunks([pa.RecordBatch.from_arrays([column], names=["text"])], "text")]
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, k) for n, k in zip(names, _KINDS, strict=True)]))

        return F.arrow_udf(run, kind)(text)

    def _rows(self, column: pa.Array) -> pa.Array:
        data, bounds = text_bytes(column)
        score, found = self.judge(data, bounds)
        n = len(score)
        text = found[:, 0].astype(np.int64)
        offending = np.bincount(text[found[:, 3] >= 0], minlength=n)
        order = np.lexsort((found[:, 1], -found[:, 3], text))
        worst = found[order[np.concatenate(([True], np.diff(text[order]) > 0))]] if len(order) else found
        held = np.bincount(text, minlength=n) > 0
        start, chars, odds = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        for i, a, b, z in worst.tolist():
            i, a, b = int(i), int(a), int(b)
            start[i], chars[i], odds[i] = _characters(data[bounds[i]:a]), _characters(data[a:b]), z
        return pa.StructArray.from_arrays(
            [pa.array(np.round(np.clip(score, 0, 1), 6)), pa.array(offending.astype(np.int32)), pa.array(start.astype(np.int32), mask=~held),
             pa.array(chars.astype(np.int32), mask=~held), pa.array(np.round(1 / (1 + np.exp(-odds)), 6), mask=~held)],
            names=["score", "offending", "worst_start", "worst_chars", "worst_score"])

    def locate(self, docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
        """``docs`` without the text, one row for every sentence that scores ``least`` or more: sentence_score, sentence, first character."""
        kind = "array<struct<sentence_start int, sentence_score double, sentence string>>"

        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in texts:
                out = []
                for p in chunks([pa.RecordBatch.from_arrays([column], names=["text"])], "text"):
                    data, bounds = text_bytes(p.column("text"))
                    rows: list[list[dict]] = [[] for _ in range(p.num_rows)]
                    for i, a, b, z in self.judge(data, bounds)[1].tolist():
                        if (share := 1 / (1 + np.exp(-z))) >= least:
                            i, a, b = int(i), int(a), int(b)
                            rows[i].append({"sentence_start": _characters(data[bounds[i]:a]), "sentence_score": round(float(share), 6),
                                            "sentence": data[a:b].tobytes().decode("utf-8", "replace")})
                    out += rows
                yield pa.array(out, pa.list_(pa.struct([("sentence_start", pa.int32()), ("sentence_score", pa.float64()), ("sentence", pa.string())])))

        found = docs.withColumn("_told", F.explode(F.arrow_udf(run, kind)(F.col(text))))
        return found.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], "_told.sentence_start", "_told.sentence_score", "_told.sentence")


_KINDS = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def word_counts(sample: DataFrame) -> DataFrame:
    """(h, toxic, clean): in how many documents of ``sample`` (text, _y) of each label a word occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            s, y = Sentences.of(*text_bytes(part.column("text"))), np.array(part.column("_y"), np.int64)
            word, at = np.unique(s.hashes, return_inverse=True)
            pair = np.unique(at * len(y) + s.text)
            label, row = y[pair % len(y)], pair // len(y)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(row, label, len(word)).astype(np.int64)),
                                              pa.array(np.bincount(row, 1 - label, len(word)).astype(np.int64))], names=["h", "toxic", "clean"])

    return sample.select("text", "_y").mapInArrow(run, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling_words(counts: DataFrame, toxic: int, clean: int, vocabulary: int, least: float) -> np.ndarray:
    """Hashes (sorted) of the words that toxic documents hold more often, G statistic above ``least``, at most ``vocabulary``."""
    n = toxic + clean
    k = F.col("toxic") + F.col("clean")
    term = lambda seen, expected: F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    g = (term(F.col("toxic"), k * (toxic / n)) + term(F.col("clean"), k * (clean / n))
         + term(toxic - F.col("toxic"), (n - k) * (toxic / n)) + term(clean - F.col("clean"), (n - k) * (clean / n)))
    best = (counts.withColumn("g", g).filter((F.col("g") > least) & (F.col("toxic") * clean > F.col("clean") * toxic))
            .orderBy(F.col("g").desc(), "h").limit(vocabulary).select("h").toArrow())
    return np.sort(np.array(best.column("h"), np.int64).view(np.uint64))


def likelihood(params: np.ndarray, sentence: np.ndarray, row: np.ndarray, text: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the labels under noisy-or, and its gradient.

    ``params``: word weights, bias, leak.  ``sentence`` and ``row`` say which words the sentences have, ``text`` whose sentences they are.
    """
    weights, bias, leak = params[:-2], params[-2], params[-1]
    z = bias + np.bincount(sentence, weights[row], len(text))
    clean = -_softplus(leak) - np.bincount(text, _softplus(z), len(y))
    toxic = np.maximum(-np.expm1(clean), 1e-12)
    loss = -np.where(y == 1, np.log(toxic), clean).mean() + decay * float(weights @ weights) / 2
    slope = np.where(y == 1, -(1 - toxic) / toxic, 1.0) / len(y)  # of the loss in the sum of softplus
    each = slope[text] / (1 + np.exp(-z))
    grad = np.concatenate([np.bincount(row, each[sentence], len(weights)) + decay * weights,
                           [each.sum(), slope.sum() / (1 + np.exp(-leak))]])
    return float(loss), grad


def train(sentence: np.ndarray, row: np.ndarray, text: np.ndarray, y: np.ndarray, words: int, steps: int = 300, rate: float = 0.1,
          decay: float = 1e-5) -> np.ndarray:
    """Weights, bias and leak by Adam over all rows."""
    params = np.concatenate([np.zeros(words), [-2.0, -4.0]])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        _, grad = likelihood(params, sentence, row, text, y, decay)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        params = params - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-10)
    return params


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_bytes: int = 1 << 17, vocabulary: int = 8192,
                 least: float = 9.0) -> ToxicityModel:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    marked = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_y")))
    # at most max_rows rows of an id and a label: a proven bound for the broadcast
    drawn = F.broadcast(marked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), text.alias("text")).filter(F.octet_length("text") <= max_bytes).join(drawn, "_id")
    one = rows.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_t"))
    sample = written(one.select("_id", "_y", F.col("_t.text").alias("text")), "toxic-sample")
    sizes = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), prior=toxic / max(1, toxic + clean))
    known = telling_words(word_counts(sample), toxic, clean, vocabulary, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            s = Sentences.of(*text_bytes(part.column("text")))
            sentence, row = s.told(known)
            whose = s.text[np.searchsorted(s.sentence, sentence)]
            at = np.searchsorted(whose, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v.astype(np.int32))) for v in (sentence, row)]
            yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.int64()), part.column("_y"), *lists], names=["id", "y", "sentence", "row"])

    # a document gives its telling words only, and there are at most max_rows of them
    got = sample.mapInArrow(run, "id long, y int, sentence array<int>, row array<int>").toArrow().sort_by("id").combine_chunks()
    dropped(sample)
    lists = [c.combine_chunks() if isinstance(c := got.column(k), pa.ChunkedArray) else c for k in ("sentence", "row")]
    size = np.diff(np.array(lists[0].offsets)) if got.num_rows else np.zeros(0, np.int64)
    text_of, sentence, row = np.repeat(np.arange(len(size)), size), *[np.array(v.flatten(), np.int64) for v in lists]
    new = np.ones(len(sentence), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (text_of[1:] != text_of[:-1])
    params = train(np.cumsum(new) - 1, row, text_of[new], np.array(got.column("y"), np.int64), len(known))
    return ToxicityModel(known, params[:-2], float(params[-2]), float(params[-1]), toxic / (toxic + clean))


HELD_OUT = (4, 2)


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict (score >= 0.3) of every document, its offending sentences and the worst; labels of fold 2 of 4 are not seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~in_fold(F.col("doc_id"), *HELD_OUT))
    model = fit_toxicity(docs, labels)
    return (docs.select("doc_id", in_fold(F.col("doc_id"), *HELD_OUT).alias("held_out"), model.score(F.col("text")).alias("_got"))
            .select("doc_id", "held_out", "_got.score", (F.col("_got.score") >= 0.3).cast("int").alias("predicted"),
                    "_got.offending", "_got.worst_start", "_got.worst_chars", "_got.worst_score"))

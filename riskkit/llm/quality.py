"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: every token has a sparse ternary index vector given by its
hash, and the vector of a word is the sum of the index vectors of its
neighbours, over all documents.  Words share ``buckets`` rows by hash, so the
table has a fixed size (buckets x dims) however large the vocabulary; each task
adds up its own table of integers and Spark sums them, so the result does not
depend on the order of rows.  Tokens are runs of letters and digits, and runs
of other characters, as written (case counts).

A document is pooled into the mean and the spread of its words' vectors; a
network with one hidden layer of ``hidden`` units gives the log-odds of label
1, divided by a temperature that is fitted on a fifth of the sample kept out
of training.

The network learns from at most ``max_rows`` labelled documents, those with the
smallest hashes of their ids, one row of each id (a bounded sample; the bound is
a parameter).
Word vectors are counted over every document.

Defined results: null and empty texts are pooled to zeros and scored like any
other; rows keep their other columns; a label row without quality is ignored,
of several for one id the largest counts; with no labels every score is 0.5,
with one class the share of label 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import chunks, prefix_sums, slices, span_hashes, text_bytes
from .catalog import query, table
from .folds import in_fold

_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 letter or digit, 2 other
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, and the number of tokens of every document."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[bounds] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    held = kind[start] > 0
    start, end = start[held], end[held]
    return span_hashes(prefix_sums(data), start, end), np.diff(np.searchsorted(start, bounds))


@dataclass(frozen=True)
class Indexing:
    """Shape of the random indexing: rows of the word table, dimensions, neighbours on each side."""

    buckets: int = 8192
    dims: int = 64
    window: int = 2

    def rows(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.buckets)).astype(np.int64)

    def index_vectors(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two places and their signs for every token hash."""
        place = np.stack([(h >> np.uint64(20)) % np.uint64(self.dims), (h >> np.uint64(32)) % np.uint64(self.dims)]).astype(np.int64)
        sign = np.stack([(h >> np.uint64(44)) & np.uint64(1), (h >> np.uint64(45)) & np.uint64(1)]).astype(np.float64) * 2 - 1
        return place, sign

    def add(self, sums: np.ndarray, h: np.ndarray, counts: np.ndarray) -> None:
        """Add a chunk's neighbourhoods to ``sums`` (buckets x (dims + 1)); the last column counts tokens."""
        doc, row = np.repeat(np.arange(len(counts)), counts), self.rows(h)
        place, sign = self.index_vectors(h)
        keys, weights = [], []
        for o in range(1, self.window + 1):
            same = doc[o:] == doc[:-o]
            for word, near in ((slice(None, -o), slice(o, None)), (slice(o, None), slice(None, -o))):
                base = row[word][same] * self.dims
                for p, s in zip(place, sign, strict=True):
                    keys.append(base + p[near][same])
                    weights.append(s[near][same])
        size = self.buckets * self.dims
        got = np.bincount(np.concatenate(keys), np.concatenate(weights), size)
        sums[:, :-1] += got.reshape(self.buckets, self.dims).astype(np.int64)
        sums[:, -1] += np.bincount(row, minlength=self.buckets)


def word_vectors(docs: DataFrame, text: str = "text", shape: Indexing = Indexing()) -> np.ndarray:
    """The word table learned from all documents: unit rows, centred; ``buckets`` rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((shape.buckets, shape.dims + 1), np.int64)
        for part in chunks(batches, "text"):
            h, counts = tokens(*text_bytes(part.column("text")))
            if len(h):
                shape.add(sums, h, counts)
        used = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["row", "v"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, "row long, v array<long>")
    total = parts.groupBy("row").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(shape.dims + 1)]).toArrow()
    out = np.zeros((shape.buckets, shape.dims))
    if total.num_rows:
        values = np.stack([np.array(c, np.float64) for c in total.columns[1:]], axis=1)
        vec, n = values[:, :-1], values[:, -1:]
        vec = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
        vec -= (vec * n).sum(0) / n.sum()
        out[np.array(total.column("row"))] = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray, shape: Indexing) -> np.ndarray:
    """Mean and spread of the words' vectors of every text (rows x 2 dims)."""
    h, counts = tokens(*text_bytes(column))
    out = np.zeros((len(counts), 2 * shape.dims), np.float32)
    held = np.flatnonzero(counts)
    starts = np.cumsum(counts[held]) - counts[held]
    for i, j in slices(counts[held], 1 << 14) if len(held) else ():  # some ten thousand words at a time
        docs, a = held[i:j], starts[i]
        got = vectors[shape.rows(h[a:a + counts[docs].sum()])]
        n = counts[docs][:, None]
        mean = np.add.reduceat(got, starts[i:j] - a, axis=0) / n
        square = np.add.reduceat(got * got, starts[i:j] - a, axis=0) / n
        out[docs] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0))], axis=1)
    return out


@dataclass(frozen=True)
class Network:
    """Standardisation, two layers and a temperature; ``prior`` alone where nothing could be learned."""

    prior: float
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, sd, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / sd @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 30, rate: float = 3e-3, seed: int = 0) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the temperature on the rest."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(y) < 10 or not 0 < y.sum() < len(y):
        return Network(prior)
    x, y = x.astype(np.float64), y.astype(np.float64)
    cut = len(y) * 4 // 5
    mean, sd = x[:cut].mean(0), x[:cut].std(0) + 1e-3
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    z = (x - mean) / sd
    m1, m2, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        order = rng.permutation(cut)
        for k in range(0, cut, 256):
            rows = order[k:k + 256]
            a = np.tanh(z[rows] @ w[0] + w[1])
            err = (1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(err, w[2]) * (1 - a * a)
            grads = [z[rows].T @ back + 1e-4 * w[0], back.sum(0), a.T @ err + 1e-4 * w[2], np.array([err.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m1[i] / (1 - 0.9 ** step)) / (np.sqrt(m2[i] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(prior, (mean, sd, *w))
    logits, labels = net.logits(x[cut:]), y[cut:]
    heat = np.exp(np.linspace(-2, 3, 201))
    loss = [np.mean(np.logaddexp(0, logits / t) - labels * logits / t) for t in heat]
    return Network(prior, net.layers, float(heat[int(np.argmin(loss))]))


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    network: Network
    shape: Indexing

    def score(self, text: Column) -> Column:
        """Score (0 to 1, to 6 places) of a text column."""
        vectors, network, shape = self.vectors, self.network, self.shape

        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in texts:
                batch = pa.RecordBatch.from_arrays([column], names=["text"])
                got = [network.scores(pooled(p.column("text"), vectors, shape)) for p in chunks([batch], "text")]
                yield pa.array(np.round(np.concatenate([np.zeros(0), *got]), 6))

        return F.arrow_udf(run, "double")(text)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, shape: Indexing = Indexing()) -> QualityModel:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    vectors = word_vectors(docs, "text", shape)
    marked = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_y")))
    held = docs.select(F.col("doc_id").alias("_id")).distinct()
    sample = marked.join(held, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    schema = "id long, y int, x array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            x = pooled(part.column("text"), vectors, shape)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "y", "x"])

    # at most max_rows rows: a proven bound for the broadcast; one row of each id (of the least text hash): the same bound for the driver
    held = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "_id")
    one = held.groupBy(F.col("_id").cast("long").alias("_id"), F.col("_y").cast("int").alias("_y")).agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_t"))
    rows = one.select("_id", "_y", F.col("_t.text").alias("text")).mapInArrow(run, schema).toArrow()
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(rows.num_rows, 2 * shape.dims)
    ids, y = np.array(rows.column("id")), np.array(rows.column("y"), np.float64)
    order = np.lexsort((*x.T[:4], ids, ids * np.int64(0x5851F42D4C957F2D)))  # shuffled alike in every run
    return QualityModel(vectors, train(x[order], y[order]), shape)


HELD_OUT = (5, 0)


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict (score >= 0.3) of every document; labels of fold 0 of 5 are not seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~in_fold(F.col("doc_id"), *HELD_OUT))
    model = fit_quality(docs, labels)
    return (docs.select("doc_id", in_fold(F.col("doc_id"), *HELD_OUT).alias("held_out"), model.score(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.3).cast("int")))

"""Language identification by a linear-chain conditional random field over words.

The words of a text (runs of ASCII letters and non-ASCII bytes, lower-cased)
are a chain, so code-switched text is labelled word by word.  A word's features
are its first and last 2, 3 and 4 bytes, its trigrams, all hashed into one
weight table, and a lexicon: the log of how often each language has the word.
Transitions are learned.  Forward-backward gives each word's posterior; a
document's language is the one with the largest mean posterior.

Lexicon counts cover all learning documents (a table of ``lexicon`` rows by
hash for each language).  Weights and transitions are fitted on a bounded
sample: about ``per_language`` documents of each language, chosen by the hash of
id and text and taken once however often they repeat; ``spans`` spans of
``span`` words of each, evenly spaced over its whole text; and from those
``chains_per_language`` times the number of languages code-switched chains of
``parts`` spans drawn at random.  All five are parameters of ``fit_languages``.

Long chains are cut into blocks whose transfer matrices are multiplied up
first, so the number of steps depends on the block length, not on the longest
text; the result is the exact forward-backward over the whole chain.

Defined results: null text, or text without a letter, is ``und`` with score 0;
rows with null language are not learned from; with nothing learned every row is
``und``; ties go to the first language by code point; repeated rows are judged
one by one; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import CHUNK_BYTES, chunks, gram_hashes, lower, prefix_sums, runs, span_hashes, text_bytes
from .catalog import query, table
from .folds import in_fold

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
AFFIXES = (2, 3, 4)
BLOCK = 64


@dataclass(frozen=True)
class Words:
    """The words of some texts: bytes, prefix sums, spans, and words per text."""

    data: np.ndarray
    sums: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> Words:
        data, bounds = text_bytes(column)
        data = lower(data)
        start, end = runs(_LETTER[data], bounds)
        return Words(data, prefix_sums(data), start, end, np.diff(np.searchsorted(start, bounds)))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.sums, self.start, self.end)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    weights: np.ndarray  # hashed features x languages
    lexicon: np.ndarray  # hashed words x languages
    scale: float
    bias: np.ndarray
    moves: np.ndarray  # languages x languages

    def affix_rows(self, w: Words) -> list[np.ndarray]:
        size = np.uint64(len(self.weights))
        out = []
        for k in AFFIXES:
            for side, h in enumerate((span_hashes(w.sums, w.start, np.minimum(w.start + k, w.end)),
                                      span_hashes(w.sums, np.maximum(w.end - k, w.start), w.end))):
                salt = np.uint64((2 * k + side) * 0x9E3779B97F4A7C15 % (1 << 64))
                out.append(((h + salt) % size).astype(np.int64))
        return out

    def gram_rows(self, w: Words) -> np.ndarray:
        """Weight row of the trigram at every byte."""
        return (gram_hashes(w.data, 3, w.sums) % np.uint64(len(self.weights))).astype(np.int64)

    def lexicon_rows(self, w: Words) -> np.ndarray:
        return (w.hashes() % np.uint64(len(self.lexicon))).astype(np.int64)

    def emissions(self, w: Words) -> np.ndarray:
        out = self.bias + self.scale * self.lexicon[self.lexicon_rows(w)]
        for rows in self.affix_rows(w):
            out = out + self.weights[rows]
        rows = self.gram_rows(w)
        total = np.zeros((len(rows) + 1, len(self.langs)))
        np.cumsum(self.weights[rows], axis=0, dtype=np.float64, out=total[1:])
        last = np.minimum(np.maximum(w.end - 2, w.start), len(rows))
        return out + total[last] - total[np.minimum(w.start, len(rows))]

    def label(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: no word) and score of every text."""
        n = np.maximum(w.counts, 1)[:, None]
        best, score = np.full(len(w.counts), -1), np.zeros(len(w.counts))
        held = np.flatnonzero(w.counts)
        if len(held):
            post = posteriors(self.emissions(w), self.moves, w.counts[held])
            mean = np.add.reduceat(post, np.cumsum(w.counts[held]) - w.counts[held], axis=0) / n[held]
            best[held] = mean.round(9).argmax(1)
            score[held] = mean.max(1)
        return best, np.clip(score, 0, 1)

    def identify(self, text: Column) -> Column:
        """Struct of lang_pred and score of a text column."""
        model, limit = self, max(1 << 16, CHUNK_BYTES * 4 // max(4, len(self.langs)))
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
        names = np.array([*self.langs, "und"], object)

        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in texts:
                got = [model.label(Words.of(p.column("text"))) for p in
                       chunks([pa.RecordBatch.from_arrays([column], names=["text"])], "text", limit)]
                best = np.concatenate([np.zeros(0, int), *[b for b, _ in got]])
                score = np.concatenate([np.zeros(0), *[s for _, s in got]])
                yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score.round(6))], fields=list(kind))

        if not self.langs:
            found = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
        else:
            found = F.arrow_udf(run, "lang_pred string, score double")(text)
        none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
        return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), found).otherwise(none)


def posteriors(emissions: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Forward-backward over consecutive chains of ``counts`` words (each at least one)."""
    psi = np.exp(emissions - emissions.max(1, keepdims=True))
    step = np.exp(moves - moves.max())
    size = moves.shape[0]
    blocks = -(-counts // BLOCK)  # per chain
    chain = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(counts) - counts, blocks) + nth * BLOCK
    width = np.minimum(BLOCK, np.repeat(counts, blocks) - nth * BLOCK)
    at = begin[:, None] + np.arange(BLOCK)
    inside = np.arange(BLOCK) < width[:, None]
    p = psi[np.where(inside, at, 0)]  # block x place x language
    # transfer matrix of every block; the move into its first word is included
    whole = np.broadcast_to(np.eye(size), (len(chain), size, size)).copy()
    for t in range(BLOCK):
        live = inside[:, t]
        new = (whole[live] @ step) * p[live, t][:, None, :]
        whole[live] = new / new.max((1, 2), keepdims=True)
    # over the blocks of each chain: what enters a block, and what follows it
    enter, follow = np.full((len(chain), size), 1.0), np.full((len(chain), size), 1.0)
    first = np.cumsum(blocks) - blocks
    for k in range(1, int(blocks.max())):
        rows = first[blocks > k] + k
        got = np.einsum("bi,bij->bj", enter[rows - 1], whole[rows - 1])
        enter[rows] = got / got.sum(1, keepdims=True)
    for k in range(1, int(blocks.max())):
        rows = (first + blocks - 1)[blocks > k] - k
        got = np.einsum("bij,bj->bi", whole[rows + 1], follow[rows + 1])
        follow[rows] = got / got.sum(1, keepdims=True)
    fore, back = np.empty_like(p), np.empty_like(p)
    now = enter
    for t in range(BLOCK):
        now = (now @ step) * p[:, t]
        now = now / now.sum(1, keepdims=True)
        fore[:, t] = now
    now = follow
    for t in range(BLOCK - 1, -1, -1):
        live = inside[:, t, None]
        back[:, t] = now
        got = (p[:, t] * now) @ step.T
        now = np.where(live, got / got.sum(1, keepdims=True), now)
    out = np.empty_like(psi)
    both = (fore * back)[inside]
    out[at[inside]] = both / both.sum(1, keepdims=True)
    return out


def fit_weights(spans: list[tuple[str, int]], langs: tuple[str, ...], lexicon: np.ndarray, table_size: int = 1 << 16,
                chains: int = 4000, parts: int = 3, epochs: int = 6, rate: float = 0.2, seed: int = 0) -> LanguageModel:
    """Adagrad on the likelihood of chains of ``parts`` spans drawn at random: labels switch where they join."""
    size = len(langs)
    model = LanguageModel(langs, np.zeros((table_size, size)), lexicon, 0.5, np.zeros(size), np.zeros((size, size)))
    if size < 2 or not spans:
        return model
    rng = np.random.default_rng(seed)
    held = {"w": np.full((table_size, size), 1e-4), "s": 1e-4, "b": np.full(size, 1e-4), "m": np.full((size, size), 1e-4)}
    by = [[i for i, s in enumerate(spans) if s[1] == k] for k in range(size)]
    used = [k for k in range(size) if by[k]]
    drawn = []
    for _ in range(chains):
        kinds = rng.choice(used, parts)
        drawn.append([spans[by[k][rng.integers(len(by[k]))]] for k in kinds])
    for _ in range(epochs):
        for k in range(0, chains, 100):
            group = drawn[k:k + 100]
            texts = [" ".join(t for t, _ in c) for c in group]
            w = Words.of(pa.array(texts, pa.string()))
            per = [int(n) for n in Words.of(pa.array([t for c in group for t, _ in c], pa.string())).counts]
            gold = np.repeat([lab for c in group for _, lab in c], per)
            weights, s, b, moves = _step(model, w, gold, held, rate)
            model = LanguageModel(langs, weights, lexicon, s, b, moves)
    return model


def _step(model: LanguageModel, w: Words, gold: np.ndarray, held: dict, rate: float) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    size = len(model.langs)
    counts = w.counts[w.counts > 0]
    emit = model.emissions(w)
    post = posteriors(emit, model.moves, counts)
    miss = post - np.eye(size)[gold]
    last = np.cumsum(counts) - 1
    pair = np.setdiff1d(np.arange(len(gold) - 1), last, assume_unique=True)
    # expected moves from the posteriors of neighbours: p(a, b) = fore(a) move psi(b) back(b), by the same chain
    joint = _pairs(emit, model.moves, counts, pair)
    real = np.zeros((size, size))
    np.add.at(real, (gold[pair], gold[pair + 1]), 1)
    n = len(gold)
    lex = model.lexicon[model.lexicon_rows(w)]
    grad_w = np.zeros_like(model.weights)
    for rows in model.affix_rows(w):
        for k in range(size):
            grad_w[:, k] += np.bincount(rows, miss[:, k], len(grad_w))
    per = np.maximum(w.end - w.start - 2, 0)  # trigrams of every word
    grams, word = model.gram_rows(w), np.repeat(np.arange(n), per)
    place = np.repeat(w.start - (np.cumsum(per) - per), per) + np.arange(len(word))
    for k in range(size):
        grad_w[:, k] += np.bincount(grams[place], miss[word, k], len(grad_w))
    grads = {"w": grad_w / n + 1e-7 * model.weights, "s": float((miss * lex).sum() / n), "b": miss.mean(0), "m": (joint - real) / n}
    now = {"w": model.weights, "s": model.scale, "b": model.bias, "m": model.moves}
    out = {}
    for key, g in grads.items():
        held[key] = held[key] + g * g
        out[key] = now[key] - rate * g / np.sqrt(held[key])
    return out["w"], float(out["s"]), out["b"], out["m"]


def _pairs(emit: np.ndarray, moves: np.ndarray, counts: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Summed posterior of (language, next language) over the places ``pair``, chain by chain in step."""
    psi, step = np.exp(emit - emit.max(1, keepdims=True)), np.exp(moves - moves.max())
    first, longest = np.cumsum(counts) - counts, int(counts.max())
    fore, back = np.ones_like(psi), np.ones_like(psi)
    for t in range(longest):
        rows = first[counts > t] + t
        got = (fore[rows - 1] @ step if t else np.ones((len(rows), psi.shape[1]))) * psi[rows]
        fore[rows] = got / got.sum(1, keepdims=True)
    for t in range(1, longest):
        rows = (first + counts - 1)[counts > t] - t
        got = (psi[rows + 1] * back[rows + 1]) @ step.T
        back[rows] = got / got.sum(1, keepdims=True)
    joint = fore[pair][:, :, None] * step * (psi * back)[pair + 1][:, None, :]
    return (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def lexicon_counts(docs: DataFrame, langs: tuple[str, ...], rows: int) -> np.ndarray:
    """Words of every language by hash, over all ``docs`` (text, lang); at most rows x languages sums reach the driver."""
    number = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(rows * len(langs), np.int64)
        for part in chunks(batches, "text"):
            w = Words.of(part.column("text"))
            lang = np.repeat([number[x] for x in part.column("lang").to_pylist()], w.counts)
            sums += np.bincount((w.hashes() % np.uint64(rows)).astype(np.int64) * len(langs) + lang.astype(np.int64), minlength=len(sums))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["k", "n"])

    total = docs.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(rows * len(langs))
    out[np.array(total.column("k"), np.int64)] = np.array(total.column("n"), np.float64)
    return out.reshape(rows, len(langs))


def sample_spans(docs: DataFrame, per: dict[str, int], per_language: int, span: int, spans: int) -> list[tuple[str, str]]:
    """Spans of words, evenly spaced over the text, of about ``per_language`` documents of each language."""
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n) * 2**31)) for k, n in per.items()])
    # id and text together: rows of a null or repeated id are drawn one by one, copies of a row count once
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31)) < share).dropDuplicates(["doc_id", "text", "lang"]).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            w = Words.of(part.column("text"))
            raw, out, at = w.data.tobytes(), [], np.cumsum(w.counts) - w.counts
            for i, lang in enumerate(part.column("lang").to_pylist()):
                n = int(w.counts[i])
                for k in sorted({j * max(0, n - span) // max(1, spans - 1) for j in range(spans)}) if n else []:
                    a, b = int(at[i]) + k, min(int(at[i]) + k + span, int(at[i]) + n)
                    out.append((" ".join(raw[w.start[j]:w.end[j]].decode("utf-8", "replace") for j in range(a, b)), lang))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["text", "lang"])

    rows = some.mapInArrow(run, "text string, lang string").toArrow()
    return sorted(zip(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), strict=True))


def fit_languages(docs: DataFrame, lexicon: int = 1 << 15, per_language: int = 1000, span: int = 16, spans: int = 4,
                  chains_per_language: int = 1000, parts: int = 3) -> LanguageModel:
    """Fit on ``docs`` (doc_id, text, lang)."""
    known = docs.filter(F.col("lang").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    per = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = tuple(sorted(per))
    if not langs:
        return LanguageModel((), np.zeros((1, 0)), np.zeros((1, 0)), 0.0, np.zeros(0), np.zeros((0, 0)))
    counts = lexicon_counts(known.select("text", "lang"), langs, lexicon)
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * lexicon))
    logs -= logs.mean(1, keepdims=True)
    number = {lang: i for i, lang in enumerate(langs)}
    drawn = [(t, number[x]) for t, x in sample_spans(known, per, per_language, span, spans)]
    return fit_weights(drawn, langs, logs, chains=chains_per_language * len(langs), parts=parts)


HELD_OUT = (4, 2)


@query("op7_language_crf")
def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 2 of 4 is not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.filter(~in_fold(F.col("doc_id"), *HELD_OUT)))
    found = docs.select("doc_id", in_fold(F.col("doc_id"), *HELD_OUT).alias("held_out"), model.identify(F.col("text")).alias("_got"))
    return found.select("doc_id", "held_out", F.col("_got.lang_pred").alias("lang_pred"), F.col("_got.score").alias("score"))

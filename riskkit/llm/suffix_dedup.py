"""Repeated passages, found by merging shard Burrows-Wheeler transforms.

A byte is removed if it lies in a string of ``length`` bytes that also starts
earlier: in a smaller document, or before in the same one.  Texts are taken as
UTF-8 bytes and matches never cross documents; overlaps count.

Sorting every suffix of a corpus is out of reach, and most of its strings occur
once.  So the work is cut down, without loss, before the transforms:

1. Every window of ``length`` bytes is owned by its *anchor*, the leftmost of
   its 16-byte grams with the least hash.  Equal windows have equal anchors, and
   the windows of one anchor are a run of starts, so a text becomes a list of
   fragments (the bytes its anchor's windows cover), one in about 43 bytes.
2. A task keeps the first of its equal fragments; the others are marked at once
   (all their windows start earlier elsewhere).  A passage, line or copy that a
   third of all rows share is so reduced to a row per task.
3. What is left is shuffled by anchor.  An anchor that occurs once has no
   repeats; equal fragments are marked but for the first; only anchors with
   different fragments, where texts agree in part, go on.

For those, buckets of whole anchors form shards.  A shard's fragments are read
as strings over symbols of half a window, one string for each phase, and its
multi-string Burrows-Wheeler transform is built.  The transforms are merged by
iterative interleave refinement: from an interleave of the shards that agrees
with the first t symbols of the suffixes, a stable sort by the transforms' next
symbols gives the one for t + 1.  Where a block of equal prefixes splits, the
round gives the length of the common prefix; blocks that survive all rounds are
the repeated windows, and all but their earliest start are marked.  No suffix
of one shard is ever compared with one of another.

An anchor with more than ``variants`` different fragments (by default as many as
a bucket holds) is not gathered in a bucket: its windows are grouped by hash with a partial minimum, which has no
hot key (and marks the same windows).

Defined results: null and empty texts have nothing to remove; texts shorter than
``length`` stay whole; a null id comes after all others; rows that repeat an id
and its text are one document and all return its result; rows that share an id
but not the text count as parts of one document, in the order of their starts
(at equal starts, of the 64-bit hashes that tell the texts apart);
an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .buffers import chunks, gram_hashes, prefix_sums, span_hashes, text_bytes
from .catalog import query, table
from .storage import written

GRAM = 16
_AT, _LAST = 12, (1 << 12) - 1  # place: start << 12 | windows - 1


def place(start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One integer for the run of windows that start at ``start`` .. ``last``."""
    return (start << _AT) | (last - start)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row."""
    n = len(values)
    rows = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def fragments(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, fragment hash, first and last window start (in ``data``) and document of every fragment."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return none
    sums = prefix_sums(data)
    gram = gram_hashes(data, GRAM, sums)
    bits = max(1, int(len(gram)).bit_length())
    low = np.uint64((1 << bits) - 1)
    # ordered by hash, then place: the least of a window's grams is its leftmost anchor
    anchor = (sliding_least((gram & ~low) | np.arange(len(gram), dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= bounds[1:][doc])
    if not len(start):
        return none
    own, at = doc[start], anchor[start]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1]))))
    begin, end = start[first], start[np.append(first[1:], len(start)) - 1]
    return gram[at[first]], span_hashes(sums, begin, end + length), begin, end, own[first]


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """Rows (h, f, ord, tie, place): fragments that are the first of their kind in their task; other ones have place < 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            data, bounds = text_bytes(part.column("text"))
            h, f, begin, end, doc = fragments(data, bounds, length)
            if not len(h):
                continue
            order, tie = (np.array(part.column(c), np.int64) for c in ("ord", "tie"))
            at = place(begin - bounds[doc], end - bounds[doc])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), f.view(np.int64), order[doc], tie[doc], at)],
                                             names=["h", "f", "ord", "tie", "place"])

    def first_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within every stretch of the task's rows, all but the first of equal fragments are marked."""
        held: list[np.ndarray] = []
        size = 0
        for batch in run(batches):
            held.append(np.stack([np.array(c) for c in batch.columns]))
            size += batch.num_rows
            if size >= 1 << 19:
                yield _first_marked(np.concatenate(held, axis=1))
                held, size = [], 0
        if held:
            yield _first_marked(np.concatenate(held, axis=1))

    return docs.mapInArrow(first_only, "h long, f long, ord long, tie long, place long")


def _first_marked(rows: np.ndarray) -> pa.RecordBatch:
    h, f, order, tie, at = rows[:, np.lexsort((rows[3], rows[4], rows[2], rows[1], rows[0]))]
    later = np.concatenate(([False], (h[1:] == h[:-1]) & (f[1:] == f[:-1])))
    # a repeated row of one document is not later than itself
    later &= ~np.concatenate(([False], (order[1:] == order[:-1]) & (tie[1:] == tie[:-1]) & (at[1:] == at[:-1])))
    h = np.where(later, h ^ (at * np.int64(0x5851F42D4C957F2D)) ^ order ^ tie, h)  # marked rows need no partner: spread them
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, f, order, tie, np.where(later, ~at, at))], names=["h", "f", "ord", "tie", "place"])


def collated(rows: DataFrame, variants: int) -> DataFrame:
    """Rows (kind, h, ord, tie, place): kind 0 is marked, 1 goes to a bucket, 2 has a crowded anchor."""
    def emit(h: np.ndarray, f: np.ndarray, order: np.ndarray, tie: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        done = at < 0
        sure = order[done], tie[done], ~at[done]
        h, f, order, tie, at = (x[~done] for x in (h, f, order, tie, at))
        s = np.lexsort((tie, at, order, f, h))
        h, f, order, tie, at = h[s], f[s], order[s], tie[s], at[s]
        new_h = np.concatenate(([True], h[1:] != h[:-1]))[:len(h)]
        new_f = new_h | np.concatenate(([True], f[1:] != f[:-1]))[:len(h)]
        head = np.maximum.accumulate(np.where(new_f, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
        later = (order != order[head]) | (tie != tie[head]) | (at != at[head])
        group = np.cumsum(new_h) - 1
        kinds = np.bincount(group, new_f)[group] if len(h) else np.zeros(0)
        open_ = new_f & (kinds > 1)
        kind = np.concatenate((np.zeros(len(sure[0]) + int(later.sum()), np.int8), np.where(kinds[open_] > variants, 2, 1).astype(np.int8)))
        cols = [np.concatenate((x, y[later], y[open_])) for x, y in zip((np.zeros(len(sure[0]), np.int64), *sure), (h, order, tie, at), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, cols)], names=["kind", "h", "ord", "tie", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            now = np.stack([np.array(c) for c in batch.columns])
            if not now.shape[1]:
                continue
            cut = int(np.searchsorted(now[0], now[0, -1]))  # rows of the last anchor wait for more
            if cut or (held and held[-1][0, -1] != now[0, 0]):
                if not cut:
                    yield emit(*np.concatenate(held, axis=1))
                    held = [now]
                    continue
                yield emit(*np.concatenate([*held, now[:, :cut]], axis=1))
                held = [now[:, cut:]]
            else:
                held.append(now)
        if held:
            yield emit(*np.concatenate(held, axis=1))

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "kind byte, h long, ord long, tie long, place long")


# --- transforms of a bucket ---------------------------------------------------

def strings(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Symbols of half a window: rank (from 1), fragment, window number, and string of every symbol, strings end to end."""
    step = length // 2
    phases = np.minimum(windows, step)
    frag = np.repeat(np.arange(len(begin)), phases)
    phase = np.arange(len(frag)) - np.repeat(np.cumsum(phases) - phases, phases)
    count = (windows[frag] - 1 - phase) // step + 2  # windows of this phase, and the half after the last
    string = np.repeat(np.arange(len(frag)), count)
    nth = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    window = phase[string] + step * nth
    at = begin[frag[string]] + window
    _, rank = np.unique(span_hashes(prefix_sums(data), at, at + step), return_inverse=True)
    small = np.int32  # a bucket has far fewer symbols; these arrays are what a task holds
    return rank.astype(small) + 1, frag[string].astype(small), window.astype(small), string.astype(small)


def transform(symbol: np.ndarray, string: np.ndarray, n_strings: int) -> tuple[np.ndarray, np.ndarray]:
    """Multi-string Burrows-Wheeler transform (0 ends a string) and the symbol that each of its rows starts at (-1: an end).

    The rows of the ends come first, in the order of the strings.
    """
    n = len(symbol)
    last = np.append(string[1:] != string[:-1], True) if n else np.zeros(0, bool)
    ahead = np.arange(n, dtype=np.int32)
    alive = np.ones(n, bool)
    longest = int(np.bincount(string).max()) if n else 0
    columns = []
    for _ in range(longest):
        columns.append(np.where(alive, symbol[np.minimum(ahead, n - 1)], 0))
        alive = alive & ~last[np.minimum(ahead, n - 1)]
        ahead = ahead + 1
    order = np.lexsort((string, *columns[::-1])) if n else np.zeros(0, np.int64)
    first = np.append(True, string[1:] != string[:-1]) if n else np.zeros(0, bool)
    before = np.where(first, 0, np.roll(symbol, 1)) if n else symbol
    return np.concatenate((symbol[last], before[order])), np.concatenate((np.full(n_strings, -1, np.int32), order.astype(np.int32)))


def merged_blocks(transforms: list[np.ndarray], n_strings: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' rows by their first ``rounds`` symbols, and the block of equal prefixes of each row.

    Refinement: rows in the interleave so far, stably sorted by the symbol before them, are their
    predecessors in the order of one more symbol.  Rows of ends stay in front.
    """
    names = np.arange(len(transforms), dtype=np.int16)
    shard, ends = np.repeat(names, [len(t) for t in transforms]), np.repeat(names, n_strings)
    block = np.zeros(len(shard), np.int32)
    for _ in range(rounds):
        symbol = np.empty(len(shard), np.int32)
        for s, t in enumerate(transforms):
            symbol[shard == s] = t
        live = np.flatnonzero(symbol)
        order = live[np.argsort(symbol[live], kind="stable")]
        # a new block where the symbol changes, or where the rows after it already differed
        new = np.concatenate(([True], (symbol[order][1:] != symbol[order][:-1]) | (block[order][1:] != block[order][:-1])))[:len(order)]
        shard = np.concatenate((ends, shard[order]))
        block = np.concatenate((np.zeros(len(ends), np.int32), np.cumsum(new, dtype=np.int32)))
    return shard, block


def later_windows(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int, shards: int = 4,
                  starts: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, window) of every window whose bytes occur in an earlier one.

    ``begin`` and ``windows`` are the fragments' places in ``data`` and their numbers of windows, earliest first.
    ``starts``: order, text hash and start of every fragment, where the windows of one id's texts may interleave.
    """
    symbol, frag, window, string = strings(data, begin, windows, length)
    cut = np.searchsorted(frag, np.arange(shards + 1) * len(begin) // shards)
    built, rows, n_strings = [], [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = string[a:b] - (string[a] if b > a else 0)
        n_strings.append(int(own[-1]) + 1 if b > a else 0)
        t, at = transform(symbol[a:b], own, n_strings[-1])
        built.append(t)
        rows.append(np.where(at >= 0, at + np.int32(a), np.int32(-1)))
    shard, block = merged_blocks(built, n_strings, rounds=2)
    at = np.empty(len(shard), np.int32)
    for s, own in enumerate(rows):
        at[shard == s] = own
    whole = at >= 0
    whole[whole] = window[at[whole]] < windows[frag[at[whole]]]  # not the half after the last window
    at, block = at[whole], block[whole]
    if not len(at):
        return at, at
    head = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    if starts is None:
        key = frag[at].astype(np.int64) * (1 << 12) + window[at]
    else:
        order, tie, start = (x[frag[at]] for x in starts)
        key = np.empty(len(at), np.int64)
        key[np.lexsort((tie, start + window[at], order))] = np.arange(len(at))
    later = key != np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(at))))
    return frag[at[later]], window[at[later]]


def bucket_marks(part: pa.Table, length: int) -> pa.Table:
    """Marked runs (ord, tie, place) of one bucket of fragments (ord, tie, place, bytes)."""
    order, tie, at = (np.array(part.column(c), np.int64) for c in ("ord", "tie", "place"))
    s = np.lexsort((tie, at, order))
    new = (order[s][1:] != order[s][:-1]) | (tie[s][1:] != tie[s][:-1]) | (at[s][1:] != at[s][:-1])
    s = s[np.concatenate(([True], new))[:len(s)]]
    order, tie, at = order[s], tie[s], at[s]
    data, bounds = text_bytes(part.column("bytes").combine_chunks().take(pa.array(s)))
    shared = bool(((order[1:] == order[:-1]) & (tie[1:] != tie[:-1])).any())  # an id with different texts
    frag, window = later_windows(data, bounds[:-1], (at & _LAST) + 1, length, starts=(order, tie, at >> _AT) if shared else None)
    s = np.lexsort((window, frag))
    frag, window = frag[s], window[s]
    new = np.flatnonzero(np.concatenate(([True], (frag[1:] != frag[:-1]) | (window[1:] != window[:-1] + 1)))[:len(frag)])
    last = np.append(new[1:], len(frag))[:len(new)] - 1
    base = at[frag[new]] >> _AT
    return pa.table({"ord": order[frag[new]], "tie": tie[frag[new]], "place": place(base + window[new], base + window[last])})


# --- the operator ---------------------------------------------------------------

def removed_runs(texts: DataFrame, length: int, variants: int, bucket_rows: int) -> DataFrame:
    """(ord, tie, places): the window starts to remove from every text that has any; ``texts``: ord, tie, text, rest."""
    marks = written(collated(anchored(texts.select("ord", "tie", "text"), length), variants), "suffix-marks")
    n_open = marks.filter("kind = 1").count()

    def cut(kind: int) -> DataFrame:
        """Bytes of the fragments of one kind: (h, ord, tie, place, bytes)."""
        wanted = marks.filter(F.col("kind") == kind).groupBy("ord", "tie").agg(F.collect_set(F.struct("h", "place")).alias("runs"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, "text"):
                data, bounds = text_bytes(part.column("text"))
                raw, runs = data.tobytes(), part.column("runs")
                size = np.array(pc.list_value_length(runs), np.int64)
                flat = runs.flatten()
                h, at = (np.array(flat.field(c), np.int64) for c in ("h", "place"))
                begin = np.repeat(bounds[:-1], size) + (at >> _AT)
                end = begin + (at & _LAST) + length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), *[pa.array(np.repeat(np.array(part.column(c), np.int64), size)) for c in ("ord", "tie")], pa.array(at),
                     pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())], names=["h", "ord", "tie", "place", "bytes"])

        # "rest" is not used here, but with it the shuffled texts are the same table as in the last step
        return texts.join(wanted, ["ord", "tie"]).select("ord", "tie", "text", "rest", "runs").mapInArrow(run, "h long, ord long, tie long, place long, bytes binary")

    buckets = max(1, -(-n_open // bucket_rows))
    bucketed = (cut(1).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
                .groupBy("bucket").applyInArrow(lambda part: bucket_marks(part, length), "ord long, tie long, place long"))

    def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "bytes"):
            data, bounds = text_bytes(part.column("bytes"))
            n = np.diff(bounds) - length + 1
            own = np.repeat(np.arange(part.num_rows), n)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            h, order, tie, at = (np.array(part.column(c), np.int64)[own] for c in ("h", "ord", "tie", "place"))
            start = (at >> _AT) + nth
            w = gram_hashes(data, length)[bounds[:-1][own] + nth] if len(own) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, w.view(np.int64), order, tie, place(start, start))],
                                             names=["h", "w", "ord", "tie", "place"])

    crowded = cut(2).mapInArrow(each_window, "h long, w long, ord long, tie long, place long")
    earliest = crowded.groupBy("h", "w").agg(F.min(F.struct("ord", "place", "tie")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = crowded.join(earliest.drop("_n"), ["h", "w"]).filter(F.struct("ord", "place", "tie") != F.col("_first")).select("ord", "tie", "place")
    every = marks.filter("kind = 0").select("ord", "tie", "place").unionByName(bucketed).unionByName(repeated)
    return every.groupBy("ord", "tie").agg(F.collect_set("place").alias("places"))


def remove_repeats(docs: DataFrame, length: int = 100, variants: int = 4096, bucket_rows: int = 4096, as_text: bool = False) -> DataFrame:
    """``docs`` without ``text``, and with n_bytes, n_removed, n_spans and the bytes ``kept`` of every row.

    ``as_text``: ``kept`` is a string instead, without the bytes of characters that a cut has split.
    ``length`` is even and from 32 to 4096.
    """
    if length % 2 or not 32 <= length <= 4096:
        raise ValueError("length must be even, from 32 to 4096")
    made = ["n_bytes", "n_removed", "n_spans", "kept"]
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.coalesce("text", F.lit("")).alias("text"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", *made)]).alias("rest"))
    texts = texts.withColumn("tie", F.xxhash64("text")).select("ord", "tie", "text", "rest")
    marked = removed_runs(texts, length, variants, bucket_rows)
    kind = pa.string() if as_text else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            data, bounds = text_bytes(part.column("text"))
            runs = part.column("places")
            size = np.array(pc.fill_null(pc.list_value_length(runs), 0), np.int64)
            at = np.array(runs.flatten(), np.int64)
            begin = np.repeat(bounds[:-1], size) + (at >> _AT)
            step = np.bincount(begin, minlength=len(data) + 1) - np.bincount(begin + (at & _LAST) + length, minlength=len(data) + 1)
            gone = np.cumsum(step[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))[bounds]
            before = np.concatenate(([False], gone[:-1]))[:len(gone)]
            before[bounds[:-1][bounds[:-1] < len(data)]] = False
            starts = np.concatenate(([0], np.cumsum(gone & ~before)))[bounds]
            left, ends = data[~gone].tobytes(), (bounds - total).tolist()
            kept = [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("rest"), *map(pa.array, (np.diff(bounds), np.diff(total), np.diff(starts))),
                 pa.array([k.decode("utf-8", "ignore") for k in kept] if as_text else kept, kind)], names=["rest", *made])

    found = texts.join(marked, ["ord", "tie"], "left").select("ord", "text", "rest", "places")
    schema = StructType([texts.schema["rest"], *[StructField(c, LongType()) for c in made[:3]], StructField("kept", StringType() if as_text else BinaryType())])
    return found.mapInArrow(run, schema).select("rest.*", *made)


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its 100-byte repeats."""
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""SimHash near-duplicate groups, linked by the generalised pigeonhole principle.

Fingerprint: bit ``b`` is 1 if it is set in over half of the XXH64 hashes of
the document's word shingles.  Two fingerprints link at ``max_bits`` or fewer
differing bits; a group is what links connect.

Linking works on the distinct fingerprints:

1. bits are grouped into partitions so that correlated bits share one (their
   co-occurrence is counted over all fingerprints);
2. thresholds ``t_i >= -1`` (-1: partition not used) with
   ``sum(t_i) = max_bits - partitions + 1`` are allotted by dynamic programming
   on the estimated number of candidates and of probes; two fingerprints within
   ``max_bits`` must agree within ``t_i`` bits in some partition ``i``, whatever
   the allotment, so it only affects cost;
3. each fingerprint is filed under its value in every used partition, and
   probes all values within ``t_i`` bits of its own; pairs met are verified.

A bucket of more than ``bucket_rows`` fingerprints (many near copies of one
document) is not paired up.  Its members are linked through midpoints instead,
which is exact as well: fingerprints within 2r bits have a common point within
r bits of both, and all fingerprints around one point lie within 2r of each
other; a point has at most 65 of them for r = 1.

Defined results: null or empty text has fingerprint zero and links like any
other; rows with a null id take part (their component is the smallest id
reachable, null if there is none); repeated rows each return a row; an empty
table gives no rows; other columns are carried where ``also`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .buffers import chunks, text_bytes
from .catalog import query, table
from .components import components
from .storage import dropped, written

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of the space-joined shingles of a text's words, repeats included."""
    joined = b" ".join(text.translate(_FOLD).split())
    if not joined:
        return []
    space = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(space) + 1 <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    start = [0, *(space[:len(space) - shingle + 1] + 1).tolist()]
    end = [*space[shingle - 1:].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(start, end, strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints (int64) of consecutive groups of ``counts`` hashes; zero for empty groups."""
    out = np.zeros(len(counts), np.int64)
    held = np.flatnonzero(counts)
    if len(held):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(counts[held]) - counts[held]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        major = (2 * ones > counts[held][:, None]).astype(np.uint8)
        out[held] = np.packbits(major, axis=1, bitorder="little").view(np.int64).ravel()
    return out


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The 64-bit fingerprint of a text column."""
    def of_chunk(column: pa.Array) -> np.ndarray:
        data, bounds = text_bytes(column)
        raw = data.tobytes()
        hashes, counts = [], np.zeros(len(column), np.int64)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            own = shingle_hashes(raw[a:b], shingle)
            counts[i] = len(own)
            hashes += own
        return majority_bits(np.array(hashes, np.uint64), counts)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *[of_chunk(p.column("text")) for p in chunks([batch], "text")]]))

    return F.arrow_udf(run, "long")(text)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for all bits i, j in how many both are set (at most 64 x 65 / 2 rows reach the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for k in range(0, len(fp), 65536):
                bits = np.unpackbits(fp[k:k + 65536].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array([*i.tolist(), -1]), pa.array([*j.tolist(), -1]), pa.array([*total[i, j].tolist(), n])],
                                         names=["i", "j", "n"])

    out, n = np.zeros((64, 64)), 0
    for i, j, c in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        if i < 0:
            n = c
        else:
            out[i, j] = out[j, i] = c
    return n, out


def bit_partitions(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal width, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    free, out = set(range(64)), []
    for k in range(parts):
        width = 64 * (k + 1) // parts - 64 * k // parts
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < width:
            nxt = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(nxt)
            free.discard(nxt)
        out.append(sorted(group))
    return out


def allot(n: int, both: np.ndarray, groups: list[list[int]], max_bits: int) -> tuple[float, list[int]]:
    """Cheapest thresholds for the partitions and their estimated cost: candidates plus probes."""
    differ = 2 * (p := np.diag(both) / max(n, 1)) * (1 - p)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        near = np.array([1.0])  # distribution of the number of differing bits of a random pair
        for b in group:
            near = np.convolve(near, [1 - differ[b], differ[b]])
        around = np.cumsum([_choose(len(group), r) for r in range(max_bits + 1)])
        cost = {-1: 0.0} | {t: n * n / 2 * float(near[:t + 1].sum()) + n * float(around[t]) for t in range(max_bits + 1)}
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t, extra in cost.items():
                if (at := used + t) not in step or c + extra < step[at][0]:
                    step[at] = (c + extra, [*chosen, t])
        best = step
    return best[max_bits - len(groups) + 1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def plan(n: int, both: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """The partitions in use with their thresholds, for the cheapest number of partitions."""
    options = []
    for parts in range(1, max_bits + 3):
        groups = bit_partitions(n, both, parts)
        cost, chosen = allot(n, both, groups, max_bits)
        options.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _masks(bits: list[int], radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(bits, r)]


def _around(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: m.bitwiseXOR(fp)))


def links(fps: DataFrame, max_bits: int = 2, bucket_rows: int = 64) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect all that lie within ``max_bits`` bits."""
    n, both = bit_counts(fps)
    filed, probes = None, None
    for i, (bits, t) in enumerate(plan(n, both, max_bits)):
        keep = _signed(sum(1 << b for b in bits))
        own = fps.select(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(keep)).alias("value"), "fp")
        near = own if t == 0 else own.withColumn("value", _around(F.col("value"), _masks(bits, t)))
        filed = own if filed is None else filed.unionByName(own)
        probes = near if probes is None else probes.unionByName(near)
    sizes = probes.groupBy("part", "value").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    small = sizes.filter(F.col("_n") <= bucket_rows).drop("_n")
    left = probes.join(small, ["part", "value"]).withColumnRenamed("fp", "u")
    right = filed.withColumnRenamed("fp", "v")
    met = left.join(right, (left["part"] == right["part"]) & (left["value"] == right["value"]) & (F.col("u") != F.col("v"))
                    & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)).select("u", "v")
    large = sizes.filter(F.col("_n") > bucket_rows).drop("_n")
    crowded = probes.join(large, ["part", "value"], "left_semi").select("fp").distinct()
    return met.unionByName(midpoint_links(crowded, max_bits))


def midpoint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges that connect all fingerprints within ``max_bits`` bits, through the points half way between them."""
    every = list(range(64))
    wide = fps.select("fp", _around(F.col("fp"), _masks(every, (max_bits + 1) // 2)).alias("mid"))
    if max_bits % 2 == 0:
        least = F.min("fp").over(Window.partitionBy("mid"))
        return wide.select(F.col("fp").alias("u"), least.alias("v")).filter("u != v").distinct()
    narrow = fps.select(F.col("fp").alias("v"), _around(F.col("fp"), _masks(every, max_bits // 2)).alias("mid"))
    return wide.withColumnRenamed("fp", "u").join(narrow, "mid").filter("u != v").select("u", "v").distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, bucket_rows: int = 64, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``fp``, ``root`` (its group's key), ``component_id`` (the smallest id reachable through links) and ``also`` of every row."""
    marked = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text"), shingle).alias("fp"), *also), "simhash")
    reps = marked.groupBy("fp").agg(F.min("doc_id").alias("_rep"))
    distinct = written(reps, "simhash-distinct")
    edges = written(links(distinct.select("fp"), max_bits, bucket_rows), "simhash-links")
    roots = components(edges)
    dropped(edges)  # the components are checkpointed
    rooted = (distinct.join(roots.select(F.col("node").alias("fp"), F.col("root").alias("_root")), "fp", "left")
              .withColumn("_root", F.coalesce("_root", "fp")))
    least = rooted.groupBy("_root").agg(F.min("_rep").alias("component_id"))
    named = rooted.join(least, "_root").select("fp", F.col("_root").alias("root"), "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "root", "component_id", *also)


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@query("op8_simhash_groups")
def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: 3-word shingles, at most 2 differing bits."""
    groups = near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, max_bits=2)
    return groups.select("doc_id", fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")

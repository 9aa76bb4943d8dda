"""Exact top-k by inner product, with an M-tree searched best first.

Vectors are made metric: with R the largest norm, every candidate x gets one
more coordinate sqrt(R^2 - |x|^2) and every query 0, so the squared distance is
|q|^2 + R^2 - 2 q.x and the nearest neighbours are the largest inner products.

Candidates are dealt over partitions by a hash of id, vector and place in the
input, so neither copies of one vector nor rows of one id meet in one task, and
each partition bulk-loads an M-tree of
pages (numpy arrays): a leaf page holds vectors with their distances to the
page's routing object, an inner page its children's routing objects, covering
radii and distances to its own routing object.  A query walks the pages in the
order of their lower bounds and stops when the next bound exceeds its k-th
distance; entries whose stored parent distance already rules them out
(triangle inequality) are passed over without computing a distance.

The queries are a stated subset of the rows.  They reach every partition as a
stream behind its candidates, so a task holds one partition's tree and one
batch of queries; the partial top-k lists are merged per query.

Scores are exact integers; distances only decide what is looked at, and bounds
carry a margin far above their rounding error.

Defined results: vectors that are null or hold null or non-finite components
take no part, as query or candidate; vectors of different length are not
compared; a query never finds rows of its own id; ties go to the smaller id;
repeated rows are candidates of their own; rows with a null id are no
candidates; a component x whose 256-fold leaves 64 bits takes its vector out
like one that is not finite, and a score beyond 64 bits wraps; an empty table
gives no rows; other columns are not carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import query, table

PAGE = 128


@dataclass
class Page:
    """Entries of a node: their points, distances to the node's routing object, and radii or rows."""

    points: np.ndarray
    to_parent: np.ndarray
    radius: np.ndarray  # of the children; zeros in a leaf
    children: list | None  # None: a leaf
    rows: np.ndarray | None
    square: np.ndarray  # |point|^2

    def distances(self, live: np.ndarray, point: np.ndarray, square: float) -> np.ndarray:
        """From ``point`` to the entries ``live``: one product of the page with the point."""
        points, own = (self.points, self.square) if len(live) == len(self.points) else (self.points[live], self.square[live])
        return np.sqrt(np.maximum(own + square - 2 * (points @ point), 0))


def distances(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    gap = points - at
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def bulk_load(points: np.ndarray, rows: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> Page:
    """The page over ``points`` whose routing object is ``at``."""
    gap = distances(points, at)
    if len(points) <= PAGE:
        return Page(points, gap, np.zeros(len(points)), None, rows, (points * points).sum(1))
    seeds = points[rng.choice(len(points), min(PAGE, -(-len(points) // (PAGE // 2))), replace=False)]
    near = np.argmin((seeds * seeds).sum(1) - 2 * points @ seeds.T, axis=1)
    groups = [np.flatnonzero(near == k) for k in range(len(seeds))]
    if max(map(len, groups)) == len(points):  # all alike: cut by number
        groups = np.array_split(np.arange(len(points)), min(PAGE, -(-len(points) // PAGE)))
        seeds = np.repeat(points[:1], len(groups), axis=0)
    held = [k for k, g in enumerate(groups) if len(g)]
    pages = [bulk_load(points[groups[k]], rows[groups[k]], seeds[k], rng) for k in held]
    radius = np.array([distances(points[groups[k]], seeds[k]).max() for k in held])
    routing = seeds[held]
    return Page(routing, distances(routing, at), radius, pages, None, (routing * routing).sum(1))


@dataclass
class MTree:
    """An M-tree over integer vectors of one length, for largest inner products."""

    vectors: np.ndarray  # rows x dims, int64
    ids: np.ndarray
    reach: float  # square of the largest norm
    routing: np.ndarray
    root: Page

    @staticmethod
    def of(vectors: np.ndarray, ids: np.ndarray, seed: int = 0) -> MTree:
        real = vectors.astype(np.float64)
        norm = (real * real).sum(1)
        reach = float(norm.max())
        points = np.concatenate([real, np.sqrt(np.maximum(reach - norm, 0))[:, None]], axis=1)
        return MTree(vectors, ids, reach, points[0], bulk_load(points, np.arange(len(ids)), points[0], np.random.default_rng(seed)))

    def search(self, vector: np.ndarray, own: int | None, k: int) -> tuple[list[tuple[int, int]], int]:
        """Best ``k`` of (score, -id) among rows whose id is not ``own``; and the number of distances computed."""
        real = vector.astype(np.float64)
        total = float(real @ real) + self.reach
        point = np.append(real, 0.0)
        margin = 1e-6 * (1 + np.sqrt(total))  # distances are exact to about 1e-7 of that
        square = float(point @ point)
        best: list[tuple[int, int]] = []  # heap: the worst on top
        bound, count, computed = np.inf, 0, 1
        queue = [(0.0, 0, self.root, float(distances(self.routing[None], point)[0]))]
        while queue and queue[0][0] <= bound + margin:
            _, _, page, gap = heapq.heappop(queue)
            # |d(query, parent) - d(entry, parent)| - radius is a lower bound that needs no distance
            live = np.flatnonzero(np.abs(gap - page.to_parent) - page.radius <= bound + margin)
            dist = page.distances(live, point, square)
            computed += len(live)
            near = np.flatnonzero(dist - page.radius[live] <= bound + margin)
            if page.children is not None:
                for i in near:
                    count += 1
                    low = max(0.0, float(dist[i] - page.radius[live[i]]))
                    heapq.heappush(queue, (low, count, page.children[live[i]], float(dist[i])))
                continue
            rows = page.rows[live[near]]
            for score, row_id in zip((self.vectors[rows] @ vector).tolist(), self.ids[rows].tolist(), strict=True):
                if row_id == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -row_id))
                elif (score, -row_id) > best[0]:
                    heapq.heapreplace(best, (score, -row_id))
            if len(best) == k:
                bound = float(np.sqrt(max(0.0, total - 2.0 * best[0][0]))) + margin
        return sorted(best, reverse=True), computed


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, every component present, finite and below 2^55 in size."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float(1 << 55))
    return embedding.isNotNull() & F.forall(embedding, real)


def search_partitions(candidates: DataFrame, queries: DataFrame, k: int, parts: int) -> DataFrame:
    """query_id, qkey, vec_id, score: the best ``k`` of every query within every partition."""
    left = candidates.select(F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(parts)).alias("part"), F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("qkey"), "v")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).alias("kind"), "id", "qkey", "v")
    rows = left.unionByName(right).repartition(parts, "part").sortWithinPartitions("part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, trees = None, [], None
        for batch in batches:
            part, kind, ids, keys = (np.array(batch.column(c)) for c in ("part", "kind", "id", "qkey"))
            column, out = batch.column("v"), []
            bounds = np.array(column.offsets, np.int64)
            flat = np.array(column.values, np.int64)
            for i in range(batch.num_rows):
                if part[i] != now:
                    now, held, trees = part[i], [], None
                vector = flat[bounds[i]:bounds[i + 1]]
                if kind[i] == 0:
                    held.append((vector.copy(), int(ids[i])))
                    continue
                if trees is None:
                    trees = {n: MTree.of(np.stack([v for v, _ in held if len(v) == n]), np.array([x for v, x in held if len(v) == n]))
                             for n in {len(v) for v, _ in held}}
                    held = []
                if len(vector) in trees:
                    best, _ = trees[len(vector)].search(vector, int(ids[i]), k)
                    out += [(int(ids[i]), int(keys[i]), -r, s) for s, r in best]
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["query_id", "qkey", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, qkey long, vec_id long, score long")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, tree_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` largest integer inner products of every query.

    ``vectors``: vec_id and an array of integers ``v``.  A partition's tree holds about ``tree_rows`` rows.
    """
    rows = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), "v", is_query.alias("_q"))
    queries = rows.filter("_q").select("id", "v", F.xxhash64("v").alias("qkey")).dropDuplicates(["id", "qkey"])
    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-rows.count() // tree_rows))
    found = search_partitions(rows, queries, k, parts)
    order = Window.partitionBy("query_id", "qkey").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


_SQL = """
WITH e AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op5_exact_topk", _SQL)
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest inner products of every vector whose id is divisible by 50, among all other vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(usable(F.col("embedding")))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))
    return exact_topk(whole, F.col("vec_id") % 50 == 0, k=5)

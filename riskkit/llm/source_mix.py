r"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot ``k`` of the schedule has the point ``frac(k * 0.618...)`` (a golden-ratio
sequence in 31-bit integers), which the cumulative target weights map to a
source; so every stretch of slots holds each source in nearly its share.  The
slots of a source are ranked, and rank ``r`` takes block ``r mod n_blocks`` of
the source's stream: its documents in the order of the MD5 of their ids, cut
into blocks of ``block_words`` words.  A second and third round over the stream
are the repeats that a source above its own size needs.

A source's share of slots is cut at its quota (the last block is taken in
part), and what the sequence still owes it at the end is added as closing
slots: so it takes exactly ``floor(target)`` words.  Discrepancy bounds the
closing slots to a few per source.

Targets: the sources by code point, null last, weigh 1, 2, 3, 1, ... of all
words; a target stops at ``max_repeats`` times its source's words, and the
excess goes to the others by weight until none is above.  That fixed point is
``min(max_repeats * size, level * weight)``; the level comes from running sums
over the sources sorted by ``size / weight``.  Only this catalogue of sources
is ever sorted as a whole.  Running sums over documents and slots have two
levels (within a bucket, and over the table of buckets), so one source holding
most rows is still spread over many tasks.

Defined results: null text has size 0; a document of size 0 takes 0; an empty
table gives no rows; null sources are one source; repeated rows are documents
of their own; rows come out once each; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import query, table
from .storage import written

WORD = r"[^\x20\x09-\x0D]+"
RING = 1 << 31
GOLDEN = 1327217885  # odd, next to RING / golden ratio
CELLS = 4096
SLOT_BLOCK = 4096


def sized(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, size and the shuffle order ``h`` (MD5 of the id) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), "source",
                       F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                       F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"))


def targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Per source: rank ``s`` (from 0), source, source_size, weight, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("s", F.row_number().over(by_name) - 1).withColumn("weight", 1 + F.col("s") % 3)
    cap = F.col("source_size") * max_repeats
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "s")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("_level", level).withColumn("_full", cap <= F.col("_level") * F.col("weight"))
    # the first source that is not stopped sets the level for all the rest
    per = per.withColumn("_level", F.min(F.when(~F.col("_full"), F.struct(F.col("source_size") / F.col("weight"), "s", "_level"))).over(every)["_level"])
    open_ = F.col("_level") * F.col("weight")
    return per.select("s", "source", "source_size", "weight",
                      F.when(F.col("_level").isNull() | (cap <= open_), cap.cast("double")).otherwise(open_).alias("target"))


def quotas(per: DataFrame, block_words: int) -> DataFrame:
    """Add blocks of the stream, slots due, and the words that the last slot takes of its block."""
    b = F.lit(block_words)
    per = per.withColumn("words", F.floor("target")).withColumn("n_blocks", F.ceil(F.col("source_size") / b))
    per = per.filter(F.col("words") > 0)
    rounds = F.expr("words div source_size")
    rest = F.col("words") - rounds * F.col("source_size")
    return (per.withColumn("_rest", rest)
            .withColumn("slots", rounds * F.col("n_blocks") + F.ceil(F.col("_rest") / b))
            .withColumn("last", F.when(F.col("_rest") > 0, F.col("_rest") - (F.ceil(F.col("_rest") / b) - 1) * b))
            .select("s", "n_blocks", "slots", "last", "words"))


def schedule(quota: DataFrame, n_slots: int) -> DataFrame:
    """slot (null: a closing one), s, rank, block, part: the words taken of the block (null: all of it)."""
    spark = quota.sparkSession
    order = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("words").over(Window.partitionBy())
    ends = quota.withColumn("_hi", F.floor(F.sum("words").over(order) / total * RING))
    ends = ends.withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("s")), F.lit(0)))
    cell = RING // CELLS
    cells = (ends.filter(F.col("_hi") > F.col("_lo"))
             .withColumn("_cell", F.explode(F.sequence(F.expr(f"_lo div {cell}"), F.expr(f"(_hi - 1) div {cell}")))))
    points = (spark.range(n_slots).withColumnRenamed("id", "slot")
              .withColumn("_p", (F.col("slot") % RING) * GOLDEN % RING)
              .withColumn("_cell", F.expr(f"_p div {cell}")))
    mapped = (points.join(cells, "_cell").filter((F.col("_p") >= F.col("_lo")) & (F.col("_p") < F.col("_hi")))
              .select("slot", F.expr(f"slot div {SLOT_BLOCK}").alias("_b"), "s"))
    per_block = mapped.groupBy("s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.select("s", "_b", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    ranked = (mapped.withColumn("_in", F.row_number().over(Window.partitionBy("_b", "s").orderBy("slot")))
              .join(before, ["s", "_b"]).select("slot", "s", (F.col("_before") + F.col("_in") - 1).alias("rank")))
    had = per_block.groupBy("s").agg(F.sum("_n").alias("_had"))
    closing = (quota.join(had, "s", "left").withColumn("_had", F.coalesce("_had", F.lit(0)))
               .filter(F.col("_had") < F.col("slots"))
               .select(F.lit(None).cast("long").alias("slot"), "s", F.explode(F.sequence("_had", F.col("slots") - 1)).alias("rank")))
    return (ranked.unionByName(closing).join(quota, "s").filter(F.col("rank") < F.col("slots"))
            .select("slot", "s", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"),
                    F.when(F.col("rank") == F.col("slots") - 1, F.col("last")).alias("part")))


def streams(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """Every document's source columns and its offset ``at`` in the shuffled stream of its source."""
    named = per.withColumn("_null", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit(""))).drop("source")
    rows = (sizes.withColumn("_null", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
            .join(named, ["_null", "_name"]).withColumn("_b", F.substring("h", 1, 3))
            .select("doc_id", "size", "h", "_b", "s", "source_size", "target"))
    sums = rows.groupBy("s", "_b").agg(F.sum("size").alias("_n"))
    run = Window.partitionBy("s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("s", "_b", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("s", "_b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(before, ["s", "_b"])
            .select("doc_id", "size", "s", "source_size", "target", (F.col("_before") + F.col("_in")).alias("at")))


def mix(docs: DataFrame, block_words: int = 64, max_repeats: int = 3, id_col: str = "doc_id") -> DataFrame:
    """doc_id (of ``id_col``), size, source_size, target and the words ``taken`` of every document."""
    spark = docs.sparkSession
    sizes = written(sized(docs, id_col), "mix-sizes")  # one pass over the texts
    per = written(targets(sizes, max_repeats), "mix-targets")
    quota = quotas(per, block_words)
    n_slots = int(per.agg(F.coalesce(F.sum(F.ceil(F.col("target") / block_words)), F.lit(0))).first()[0])
    taken = (schedule(quota, n_slots).groupBy("s", "block")
             .agg(F.sum(F.col("part").isNull().cast("long")).alias("_whole"), F.coalesce(F.max("part"), F.lit(0)).alias("_part")))
    placed = streams(sizes, per)
    b = block_words
    pieces = (placed.filter("size > 0")
              .withColumn("block", F.explode(F.sequence(F.expr(f"at div {b}"), F.expr(f"(at + size - 1) div {b}"))))
              .withColumn("_x", F.greatest("at", F.col("block") * b) - F.col("block") * b)
              .withColumn("_y", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b) - F.col("block") * b))
    words = (F.coalesce("_whole", F.lit(0)) * (F.col("_y") - F.col("_x"))
             + F.greatest(F.lit(0), F.least("_y", F.coalesce("_part", F.lit(0))) - F.col("_x")))
    full = (pieces.join(taken, ["s", "block"], "left").withColumn("_w", words)
            .groupBy("s", "at", "doc_id", "size", "source_size", "target").agg(F.sum("_w").alias("taken")))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return full.select(*cols).unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*cols))


_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), l AS (
  SELECT *, (sum(ss) OVER () - coalesce(sum(3 * ss) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv
  FROM p WINDOW b AS (ORDER BY ss / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (SELECT min_by(lv, ss / w) AS lv FROM l WHERE 3 * ss > lv * w
), t AS (
  SELECT s, source, ss, CAST(CASE WHEN lev.lv IS NULL OR 3 * ss <= lev.lv * w THEN 3 * ss ELSE lev.lv * w END AS DOUBLE) AS target
  FROM p, lev
), q0 AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS words, (ss + 63) // 64 AS nb FROM t WHERE floor(target) > 0
), q AS (
  SELECT *, (words // ss) * nb + (words % ss + 63) // 64 AS slots,
         CASE WHEN words % ss > 0 THEN words % ss - ((words % ss + 63) // 64 - 1) * 64 END AS last,
         CAST(floor(sum(words) OVER (ORDER BY s) / sum(words) OVER () * {RING}) AS BIGINT) AS hi FROM q0
), e AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY s), 0) AS lo FROM q
), k AS (
  SELECT r.range AS slot, (r.range % {RING}) * {GOLDEN} % {RING} AS pt
  FROM range((SELECT CAST(coalesce(sum(ceil(target / 64)), 0) AS BIGINT) FROM t)) r
), m AS (
  SELECT e.s, row_number() OVER (PARTITION BY e.s ORDER BY k.slot) - 1 AS rank
  FROM k JOIN e ON k.pt >= e.lo AND k.pt < e.hi
), c AS (
  SELECT s, unnest(range(coalesce(had, 0), slots)) AS rank
  FROM e LEFT JOIN (SELECT s, count(*) AS had FROM m GROUP BY s) USING (s)
), a AS (
  SELECT s, rank % nb AS block, sum(CASE WHEN rank = slots - 1 AND last IS NOT NULL THEN 0 ELSE 1 END) AS whole,
         max(CASE WHEN rank = slots - 1 THEN coalesce(last, 0) ELSE 0 END) AS part
  FROM (SELECT * FROM m UNION ALL SELECT * FROM c) JOIN e USING (s) WHERE rank < slots GROUP BY 1, 2
), g AS (
  SELECT doc_id, size, t.s, ss, target,
         coalesce(sum(size) OVER (PARTITION BY t.s ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, CASE WHEN size > 0 THEN unnest(range(CAST(at0 // 64 AS BIGINT), CAST((at0 + size - 1) // 64 + 1 AS BIGINT))) END AS block
  FROM g WHERE size > 0
)
SELECT doc_id, size, ss AS source_size, target,
       CAST(sum(coalesce(whole, 0) * (least(at0 + size, (x.block + 1) * 64) - greatest(at0, x.block * 64))
         + greatest(0, least(least(at0 + size, (x.block + 1) * 64) - x.block * 64, coalesce(part, 0))
                       - (greatest(at0, x.block * 64) - x.block * 64))) AS BIGINT) AS taken
FROM x LEFT JOIN a ON x.s = a.s AND x.block = a.block GROUP BY doc_id, size, ss, target, x.s, at0
UNION ALL SELECT doc_id, size, ss, target, 0 FROM g WHERE size = 0
"""


@query("op9_source_mix", _SQL)
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))

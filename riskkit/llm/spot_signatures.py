"""SpotSigs document fingerprints, in DataFrame functions only.

A signature is an anchor (a very common word) with the chain of the next
``chain`` content words after it, common words skipped; a chain at the end of a
text may be shorter.  So that lists, tables and texts in other languages have
signatures too, one content word in ``sparse`` (by its hash) is an anchor as well.  A document's fingerprint is the set of the 32-bit hashes
of its signatures, sorted.  Likeness is the Jaccard coefficient of two sets.

Words are runs of letters, digits and non-ASCII characters, lower-cased; the
anchors are a parameter (common English, German, French and Spanish words), so
a fingerprint never depends on the rest of the corpus.  The ``j``-th anchor of a
text at word position ``p`` has ``p - j`` content words before it, so its chain
is a slice of the array of content words: no running state is needed.

``near_duplicates`` compares all documents: sets are partitioned by length into
classes so wide that likeness ``>= threshold`` only occurs within a class or
between neighbours; within those, a document is met through the rarest
signatures of its prefix (``|A| - ceil(threshold * |A|) + 1`` of them, the
number that two such sets cannot both miss), and a pair is verified only if its
lengths and the places of the shared signature still allow the threshold.

Defined results: null text is empty; a text without any anchor has one
signature, the hash of all its words, so equal texts always have equal
fingerprints and likeness 1; repeated rows each return a row; a table of one
document is its own next document; an empty table gives no rows; other columns
are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import ordered_positions
from .catalog import query, table
from .components import components
from .storage import dropped, written

# Common words of English, German, French and Spanish.
ANCHORS = tuple("""
the of and a to in is that it was for on are as with be at this from he by or an they have not which
der die das und den von zu mit ist des sich auf ein eine dem nicht als auch es im
le la les de des et un une du en que qui dans pour par sur est au pas il elle
el los las y del se por para con una no su al lo como ser
""".split())
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column, anchors: Sequence[str] = ANCHORS, chain: int = 2, sparse: int = 8) -> Column:
    """Sorted array of the distinct 32-bit signature hashes of a text."""
    common = [str(a) for a in anchors]

    def of_words(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(common), i)), lambda p: p.isNotNull())
        content = F.filter(words, lambda w: ~w.isin(common))
        after = lambda c, at: [F.get(c, at + k) for k in range(chain)]
        spots = _let(F.struct(places.alias("p"), content.alias("c")), lambda x: F.concat(
            F.transform(x["p"], lambda p, j: F.hash(F.get(words, p), *after(x["c"], p - j))),
            F.filter(F.transform(x["c"], lambda w, q: F.when(F.hash(w) % sparse == 0, F.hash(w, *after(x["c"], q + 1)))),
                     lambda h: h.isNotNull())))
        return F.when(F.size(spots) > 0, spots).otherwise(F.array(F.hash(F.concat_ws(" ", words))))

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), lambda w: w != "")
    return F.array_sort(F.array_distinct(_let(words, of_words)))


def fingerprint_text(sigs: Column) -> Column:
    """A signature set as text: eight hex digits for each."""
    return F.concat_ws("", F.transform(sigs, lambda s: F.lpad(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard coefficient of two signature sets; 0 without a look inside if their lengths rule ``threshold`` out."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    value = F.when(a == b, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))
    return F.when(small < large * threshold, F.lit(0.0)).otherwise(value) if threshold > 0 else value


def next_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, next_id) in descending order of the distinct ids; the first follows the last.  Nulls come last."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).distinct()
    placed = ordered_positions(ids, [F.col("id").desc_nulls_last()], pos_col="pos")
    n = placed.agg(F.max("pos")).first()[0] or 0
    after = placed.select(F.col("id").alias("next_id"), F.when(F.col("pos") == 1, F.lit(n)).otherwise(F.col("pos") - 1).alias("pos"))
    return placed.join(after, "pos").select("id", "next_id")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, chain: int = 2) -> DataFrame:
    """doc_id and class_id: the least id among documents linked by likeness ``>= threshold`` (0 < threshold < 1)."""
    sets = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text"), chain=chain).alias("sigs")), "spots")
    reps = sets.withColumn("node", F.xxhash64(F.col("sigs"))).groupBy("node").agg(F.min("sigs").alias("sigs"), F.min("doc_id").alias("_rep"))
    reps = written(reps.withColumn("n", F.size("sigs")), "spots-distinct")
    # class k holds lengths in [threshold^-k, threshold^-(k+1)): partners are at most one class away
    one = reps.withColumn("k", F.floor(F.log("n") / -F.log(F.lit(threshold))))
    spots = one.select("node", "n", "k", F.explode("sigs").alias("sig"))
    freq = spots.groupBy("sig").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    rare = Window.partitionBy("node").orderBy("f", "sig")
    prefix = (spots.join(freq, "sig", "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("at", F.row_number().over(rare))
              .filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).filter("f > 1"))
    a = prefix.select(F.col("node").alias("u"), F.col("n").alias("na"), "sig", F.col("at").alias("pa"),
                      F.explode(F.array("k", F.col("k") + 1)).alias("k"))
    b = prefix.select(F.col("node").alias("v"), F.col("n").alias("nb"), "sig", F.col("at").alias("pb"), "k")
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1  # most signatures still shared
    met = (a.join(b, ["sig", "k"]).filter((F.col("u") != F.col("v")) & (F.col("nb") >= F.col("na") * threshold)
                                          & (F.col("na") >= F.col("nb") * threshold)
                                          & (left >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9))
           .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    sided = met.join(reps.select(F.col("node").alias("u"), F.col("sigs").alias("su")), "u").join(
        reps.select(F.col("node").alias("v"), F.col("sigs").alias("sv")), "v")
    edges = written(sided.filter(likeness(F.col("su"), F.col("sv"), threshold) >= threshold).select("u", "v"), "spots-links")
    roots = components(edges)
    dropped(edges)  # the components are checkpointed
    rooted = reps.select("node", "_rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("_rep").alias("class_id"))
    named = rooted.join(least, "root").select("node", "class_id")
    return sets.withColumn("node", F.xxhash64(F.col("sigs"))).join(named, "node").select("doc_id", "class_id")


def edited_texts(docs: DataFrame) -> DataFrame:
    """Every row with its signatures, its edited text and the next document's signatures.

    The texts are shuffled once, by id: the same exchange serves to cut the
    pieces that the previous documents ask for and to receive them.  Where the
    next id has several rows, the least text of them is taken.
    """
    # the key is the id as text, null as "": no column is left out on either side, else the exchange would not be shared
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(key("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("sigs", signatures(F.col("text")))
    asked = next_ids(docs).select(key("next_id").alias("_id"), key("id").alias("_for"))
    asked = asked.join(docs.groupBy(key("doc_id").alias("_for")).agg(F.max(F.length("text")).alias("_k")), "_for")
    piece = F.expr("substring(text, 1, cast(coalesce(_k, 0) div 3 as int))")
    sent = (rows.join(asked, "_id").select(F.col("_for").alias("_id"), piece.alias("_piece"), F.col("sigs").alias("next_sigs"))
            .groupBy("_id").agg(F.min(F.struct("_piece", "next_sigs")).alias("_next")))
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - length(text) div 3 as int))"),
                      F.expr("substring(_next._piece, 1, cast(length(text) div 3 as int))"))
    return rows.join(sent, "_id").select(F.expr("cast(nullif(_id, '') as bigint)").alias("doc_id"),
                                         F.length("text").cast("long").alias("n_chars"), "sigs", edited.alias("edited"),
                                         F.col("_next.next_sigs").alias("next_sigs"))


@query("op2_spot_signatures")
def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    rows = edited_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       fingerprint_text(F.col("sigs")).alias("fingerprint"),
                       fingerprint_text(F.col("edited_sigs")).alias("edited_fingerprint"),
                       likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                       likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))

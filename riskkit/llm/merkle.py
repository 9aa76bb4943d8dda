"""Merkle manifest of a dataset, by time-forward processing up the trees and a reversed sweep down.

Every row is a leaf; the leaves of one tree key (a language) form a tree in
which every two consecutive nodes become the hash of their digests, level by
level, and the trees' roots form one more tree the same way.

Nodes are worked off in the order of their labels (last leaf below, level), so
children come before parents.  A priority queue ordered by label takes each
digest to the parent; in this order it never holds more than one entry a
level.  The reversed sweep runs the same labels backwards: a queue hands every
node the steps of its proof from there to the root (its proof suffix), and the
node hands each child that suffix with the sibling's digest before it.

Across tasks the queue is Spark's sorted shuffle, which lives on disk: leaves
are placed by a range-partitioned numbering, blocks of ``2 ** LEVELS``
consecutive nodes are a task's unit of work, a block's top digest is the
message to its parent block, and block suffixes come back the same way.  A tree
over n leaves takes log2(n) / LEVELS rounds, and a language that holds all rows
is as many blocks as any other rows would be.

Defined results: null fields are ``-``; a null key is a tree of its own, before
the others; rows of one key and id are ordered by their digests, a null id
first; an integer that cannot grow in its type still grows by one in the
tampered leaf; a null id is not tampered with; an empty table gives no rows;
other columns pass through unless they are named like a result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import ordered_positions
from .catalog import query, table
from .storage import dropped, written

LEVELS = 12


def digest_of(texts: Iterable[str]) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


# --- one block --------------------------------------------------------------------

def sweep_up(digests: Sequence[str], height: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """Top digest of a block ``height`` levels above ``digests``, and its nodes (level, index, children) in label order."""
    last, queue, nodes, top = len(digests) - 1, [], [], digests[0]
    for i, leaf in enumerate(digests):
        level, at, digest = 0, i, leaf
        while True:
            if level == height:
                top = digest
            else:
                up = at >> 1
                heapq.heappush(queue, (min((up + 1 << level + 1) - 1, last), level + 1, up, at & 1, digest))
            if not queue or queue[0][0] > i:  # the next label lies ahead: read on
                break
            level, at, children = queue[0][1], queue[0][2], []
            while queue and queue[0][1:3] == (level, at):
                children.append(heapq.heappop(queue)[4])
            nodes.append((level, at, children))
            digest = digest_of(children)
    return top, nodes


def sweep_down(nodes: Sequence[tuple[int, int, list[str]]], suffix: str, size: int) -> list[str]:
    """Proof suffixes of the ``size`` lowest nodes of a block whose top has ``suffix``.

    A suffix is a run of steps from the node upwards: ``L`` or ``R`` and the
    digest of the sibling on that side, or ``-`` where there is none.
    """
    out, queue = [suffix] * size, []
    if nodes:
        heapq.heappush(queue, (0, 0, -nodes[-1][0], -nodes[-1][1], suffix))
    for level, at, children in reversed(nodes):
        _, _, _, _, own = heapq.heappop(queue)
        for j, step in enumerate(["-"] if len(children) == 1 else ["R" + children[1], "L" + children[0]]):
            child = 2 * at + j
            if level == 1:
                out[child] = step + own
            else:
                heapq.heappush(queue, (-min((child + 1 << level - 1) - 1, size - 1), 1 - level, 1 - level, -child, step + own))
    return out


def steps(suffix: str) -> Iterator[tuple[str, str]]:
    """(side, sibling) of every step of a suffix."""
    i = 0
    while i < len(suffix):
        if suffix[i] == "-":
            yield "-", ""
            i += 1
        else:
            yield suffix[i], suffix[i + 1:i + 65]
            i += 65


def folded(digest: str, suffix: str) -> str:
    """The root that a leaf's digest and its proof lead to."""
    for side, sibling in steps(suffix):
        digest = digest_of((sibling, digest) if side == "L" else (digest, sibling))
    return digest


# --- whole trees ------------------------------------------------------------------

def _height(n: int, levels: int) -> int:
    return min(levels, (n - 1).bit_length())


def _by_place(block: pa.Table) -> pa.Table:
    return block.sort_by("pos")


def climb(leaves: DataFrame, name: str, height: int) -> list[DataFrame]:
    """Nodes (tree, pos, n, digest) at every ``height``-th level, from the leaves to one node a tree.

    ``pos`` counts from 0 within the tree, ``n`` is the number of the tree's nodes at that level.
    """
    def run(block: pa.Table) -> pa.Table:
        block = _by_place(block)
        n = block.column("n")[0].as_py()
        top, _ = sweep_up(block.column("digest").to_pylist(), _height(n, height))
        return pa.table({"tree": [block.column("tree")[0].as_py()], "pos": [block.column("pos")[0].as_py() >> height],
                         "n": [-(-n >> height)], "digest": [top]})

    levels = [leaves]
    while True:
        now = levels[-1].select("tree", "pos", "n", "digest")
        todo = now if len(levels) == 1 else now.filter("n > 1")
        blocks = todo.groupBy("tree", F.shiftright("pos", height).alias("block"))
        levels.append(written(blocks.applyInArrow(run, "tree string, pos long, n long, digest string"), name))
        if (levels[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return levels


_PROVED = "tree string, pos long, suffix string, subroot string, root string"


def descend(levels: list[DataFrame], tops: DataFrame, down_to: int, height: int) -> DataFrame:
    """Suffixes (with subroot and root) of the nodes of ``levels[down_to]``; ``tops`` has those of the trees' own roots."""
    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block = _by_place(block)
        top = above.to_pylist()[0]
        _, nodes = sweep_up(block.column("digest").to_pylist(), _height(block.column("n")[0].as_py(), height))
        found = sweep_down(nodes, top["suffix"], block.num_rows)
        same = lambda k: [top[k]] * block.num_rows
        return pa.table({"tree": same("tree"), "pos": block.column("pos"), "suffix": found, "subroot": same("subroot"), "root": same("root")})

    have = None
    for t in range(len(levels) - 1, down_to - 1, -1):
        if t < len(levels) - 1:
            nodes = levels[t].select("tree", "pos", "n", "digest")
            nodes = (nodes if t == 0 else nodes.filter("n > 1")).withColumn("block", F.shiftright("pos", height))
            have = (nodes.groupBy("tree", "block").cogroup(have.withColumn("block", F.col("pos")).groupBy("tree", "block"))
                    .applyInArrow(run, _PROVED))
        if t > 0:
            done = levels[t].filter("n = 1").select("tree", "pos").join(tops, "tree").select("tree", "pos", "suffix", "subroot", "root")
            have = done if have is None else have.unionByName(done)
    return have


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with their place ``pos`` (from 0) in ``order`` within ``tree`` and the tree's number of rows ``n``."""
    return ordered_positions(rows, order, by=["tree"], pos_col="pos", count_col="n").withColumn("pos", F.col("pos") - 1)


def manifest(rows: DataFrame, height: int = LEVELS) -> DataFrame:
    """(…, leaf, subroot, root, proof_sha256, folded_root, verified) of ``rows``: tree, doc_id, leaf, presented, …

    ``leaf`` is the digest that the trees are built from, ``presented`` the one
    that the proof is checked with (null: the same).  A block holds
    ``2 ** height`` nodes.
    """
    extra = [c for c in rows.columns if c not in ("tree", "leaf", "presented", "pos", "n", "digest")]
    leaves = placed(rows.withColumn("digest", F.col("leaf")), ["doc_id", "digest"])
    levels = climb(leaves, "merkle-nodes", height)
    roots = levels[1].filter("n = 1")
    for more in levels[2:]:
        roots = roots.unionByName(more.filter("n = 1"))
    subroots = placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), ["key"])
    tops = climb(subroots, "merkle-tops", height)
    crown = tops[-1].select("tree", F.lit("").alias("suffix"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    proved = descend(tops, crown, 0, height)
    known = written(subroots.select("pos", "key", "digest").join(proved, "pos")
                    .select(F.col("key").alias("tree"), "suffix", F.col("digest").alias("subroot"), "root"), "merkle-subroots")
    above = descend(levels, known, 1, height)
    kept = leaves.select("tree", "pos", "n", "leaf", "presented", *[F.col(f"`{c}`") for c in extra])
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in extra)

    def run(block: pa.Table, top: pa.Table) -> pa.Table:
        block = _by_place(block)
        top = top.to_pylist()[0]
        digests = block.column("leaf").to_pylist()
        _, nodes = sweep_up(digests, _height(block.column("n")[0].as_py(), height))
        found = sweep_down(nodes, top["suffix"], block.num_rows)
        shown = [p if p is not None else d for p, d in zip(block.column("presented").to_pylist(), digests, strict=True)]
        bare = str.maketrans("", "", "LR-")
        return pa.table({**{c: block.column(c) for c in extra}, "leaf": digests, "subroot": [top["subroot"]] * block.num_rows,
                         "root": [top["root"]] * block.num_rows, "proof_sha256": [digest_of((s.translate(bare),)) for s in found],
                         "folded_root": [folded(d, s) for d, s in zip(shown, found, strict=True)]})

    blocks = kept.withColumn("block", F.shiftright("pos", height)).groupBy("tree", "block")
    tops_of = above.withColumn("block", F.col("pos")).groupBy("tree", "block")
    out = blocks.cogroup(tops_of).applyInArrow(
        run, f"{kinds}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(doc_id: Column) -> Column:
    """Whether 7 divides the unsigned CRC-32 of the id's decimal text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``documents`` rows: doc_id, its language's tree, the digest, and the tampered one where there is one."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    columns = lambda n_chars: [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), leaf_digest(columns(F.col("n_chars"))).alias("leaf"),
        F.when(tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), leaf_digest(columns(more))).alias("presented"))


def _sql_field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_SQL = f"""
WITH RECURSIVE crc(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) g(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS tab FROM crc WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS r, *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen(doc_id::VARCHAR) + 1),
             lambda j: ord(substr(doc_id::VARCHAR, j, 1))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS crc
  FROM documents, tab
), l AS (
  SELECT r, doc_id, tree, {_sql_leaf('n_chars')} AS leaf,
         CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN {_sql_leaf('(n_chars::HUGEINT + 1)')} ELSE {_sql_leaf('n_chars')} END AS shown
  FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l
), nodes(tree, level, pos, n, digest) AS (
  SELECT tree, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1
  GROUP BY tree, level, pos // 2, n
), subs AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM subs
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n
), up(r, tree, level, pos, n, proof, now) AS (
  SELECT r, tree, 0, pos, n, '', shown FROM p
  UNION ALL
  SELECT u.r, u.tree, u.level + 1, u.pos // 2, (u.n + 1) // 2, u.proof || coalesce(s.digest, ''),
         sha256(CASE WHEN u.pos % 2 = 1 THEN s.digest || u.now ELSE u.now || coalesce(s.digest, '') END)
  FROM up u LEFT JOIN nodes s ON s.tree = u.tree AND s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1
), top(r, tree, level, pos, n, proof, now) AS (
  SELECT u.r, u.tree, 0, s.pos, s.n, u.proof, u.now FROM up u JOIN subs s ON s.tree = u.tree WHERE u.n = 1
  UNION ALL
  SELECT u.r, u.tree, u.level + 1, u.pos // 2, (u.n + 1) // 2, u.proof || coalesce(s.digest, ''),
         sha256(CASE WHEN u.pos % 2 = 1 THEN s.digest || u.now ELSE u.now || coalesce(s.digest, '') END)
  FROM top u LEFT JOIN tops s ON s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, w.digest AS root, sha256(t.proof) AS proof_sha256, t.now AS folded_root, t.now = w.digest AS verified
FROM p JOIN subs s ON s.tree = p.tree JOIN top t ON t.r = p.r AND t.n = 1 JOIN tops w ON w.n = 1
"""


@query("op12_merkle_manifest", _SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a tampered or original leaf folds back to the root."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    out = manifest(written(document_leaves(docs), "merkle-leaves"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

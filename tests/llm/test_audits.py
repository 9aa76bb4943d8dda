"""Toxicity on held-out rows and its likelihood; the Merkle manifest and the filter audit against plain versions; edge cases."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskkit.llm import filter_audit as audit
from riskkit.llm import merkle
from riskkit.llm import toxicity as tox
from riskkit.llm.buffers import text_bytes
from riskkit.llm.catalog import QUERIES
from riskkit.llm.salted import look_up


# --- toxicity --------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op11_toxicity"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    bad, good = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None, :]).mean() + (bad[:, None] == good[None, :]).mean() / 2 > 0.95
    assert (held[held.toxic == 1].predicted == 1).mean() > 0.85 and (held[held.toxic == 0].predicted == 0).mean() > 0.97
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def _planted(spark):
    clean = ["the river ran past the stone garden", "a letter lay on the copper ladder", "winter came to the window"]
    rows = []
    for i in range(120):
        sentences = [clean[(i + k) % 3] + f" w{i * 7 + k}" for k in range(1 + i % 5)]
        if i % 4 == 0:
            sentences.insert(i % len(sentences), f"You utter BLOCKHEAD w{i}{'!' * (i % 3)}")
        rows.append((i, ". ".join(sentences) + "."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")


def test_offending_sentences_are_located(spark):
    docs, labels = _planted(spark)
    model = tox.fit_toxicity(docs, labels)
    text = dict(docs.collect())
    found = model.locate(docs.withColumn("n", F.lit("x"))).collect()
    assert {r.doc_id for r in found} == {i for i in range(120) if i % 4 == 0} and {r.n for r in found} == {"x"}
    for r in found:
        assert text[r.doc_id][r.sentence_start:r.sentence_start + len(r.sentence)] == r.sentence and "BLOCKHEAD" in r.sentence
    worst = docs.select("doc_id", model.score(F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    for r in worst:
        if r.doc_id % 4 == 0:
            assert r.score > 0.5 and r.offending == 1 and "BLOCKHEAD" in text[r.doc_id][r.worst_start:r.worst_start + r.worst_chars]
        else:
            assert r.score < 0.3 and r.offending == 0


def test_likelihood_gradient_and_noisy_or():
    r = np.random.default_rng(0)
    sentence, text = np.sort(r.integers(0, 12, 40)), np.sort(r.integers(0, 6, 12))
    row, y = r.integers(0, 5, 40), np.array([0, 1, 1, 0, 1, 0])
    params = np.concatenate([r.normal(size=5), [-1.0, -2.0]])
    loss, grad = tox.likelihood(params, sentence, row, text, y, 0.01)
    z = params[5] + np.bincount(sentence, params[row], 12)
    clean = np.array([(1 - 1 / (1 + np.exp(-params[6]))) * np.prod(1 - 1 / (1 + np.exp(-z[text == d]))) for d in range(6)])
    assert np.isclose(loss, -np.where(y == 1, np.log(1 - clean), np.log(clean)).mean() + 0.005 * params[:5] @ params[:5])
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        slope = (tox.likelihood(params + step, sentence, row, text, y, 0.01)[0] - tox.likelihood(params - step, sentence, row, text, y, 0.01)[0]) / 2e-6
        # the decay holds for the weights alone
        assert np.isclose(slope, grad[i], atol=1e-6)


def test_long_texts_are_judged_piece_by_piece(spark, monkeypatch):
    docs, labels = _planted(spark)
    model = tox.fit_toxicity(docs, labels)
    data, bounds = text_bytes(pa.array([". ".join(t for _, t in docs.collect()), "no end " * 300, "x" * 3000]))
    whole = model.judge(data, bounds)
    cuts, owner = tox.pieces(data, bounds, 500)
    assert np.diff(cuts).max() <= 500 and (np.diff(owner) >= 0).all() and set(bounds) <= set(cuts)
    monkeypatch.setattr(tox, "CHUNK_BYTES", 500)
    monkeypatch.setattr(tox.pieces, "__defaults__", (500,))
    pieced = model.judge(data, bounds)
    assert np.allclose(whole[0], pieced[0]) and np.allclose(whole[1], pieced[1])


def test_toxicity_edges(spark, edge_docs, edge_rows, empty_docs, clashing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    model = tox.fit_toxicity(edge_docs, labels, least=0.5)
    for docs in (edge_docs, clashing):
        rows = docs.select("doc_id", "text", model.score(F.col("text")).alias("s")).select("text", "s.*").collect()
        assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
        leak = {r.score for r in rows if not r.text or not re.search(r"[^\W\d]", r.text)}
        assert len(leak) == 1
    assert set(model.locate(clashing, least=0.0).columns) == {*clashing.columns, "sentence", "sentence_score", "sentence_start"} - {"text"}
    none = tox.fit_toxicity(edge_docs, labels.filter("false"))
    assert {r.s.score for r in edge_docs.select(none.score(F.col("text")).alias("s")).collect()} == {0.0}
    ones = tox.fit_toxicity(edge_docs, labels.filter("toxic = 1"))
    assert {r.s.score for r in edge_docs.select(ones.score(F.col("text")).alias("s")).collect()} == {1.0}
    assert tox.fit_toxicity(empty_docs, labels).prior == 0.0
    assert empty_docs.select(model.score(F.col("text")).alias("s")).count() == 0


def test_a_hot_id_is_one_row_of_the_sample(spark):
    docs, labels = _planted(spark)
    hot = spark.range(400).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("hot text "), "id").alias("text"))
    model = tox.fit_toxicity(docs.filter("doc_id != 3").unionByName(hot), labels)
    plain = tox.fit_toxicity(docs.filter("doc_id != 3").unionByName(hot.orderBy(F.xxhash64("text")).limit(1)), labels)
    assert np.array_equal(model.known, plain.known) and np.allclose(model.weights, plain.weights)


# --- merkle -------------------------------------------------------------------------------

def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for i, source, lang, n, text in rows:
        leaf = _h(*map(_field, (i, source, lang, n, text)))
        shown = leaf
        if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0:
            shown = _h(*map(_field, (i, source, lang, n + 1, text)))
        trees.setdefault(lang, []).append((i, leaf, shown))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([_h(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
        return out

    def path(up, k):
        for level in up[:-1]:
            yield (k % 2, level[k ^ 1]) if k ^ 1 < len(level) else (0, "")
            k //= 2

    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subs[lang] = levels([leaf for _, leaf, _ in trees[lang]])
    top = levels([subs[lang][-1][0] for lang in order])
    out = []
    for at, lang in enumerate(order):
        for k, (i, leaf, shown) in enumerate(trees[lang]):
            proof, now = "", shown
            for right, sibling in [*path(subs[lang], k), *path(top, at)]:
                proof, now = proof + sibling, _h(sibling, now) if right else _h(now, sibling)
            out.append((i, leaf, subs[lang][-1][0], top[-1][0], _h(proof), now, now == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _manifest(docs, height=merkle.LEVELS):
    out = merkle.manifest(merkle.document_leaves(docs), height)
    return sorted([tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest_equals_a_plain_one(spark, edge_docs, clashing, levels):
    for docs in (edge_docs, clashing.drop("n_chars"), edge_docs.withColumn("lang", F.lit("en")), edge_docs.limit(1)):
        docs = docs.withColumn("n_chars", F.when(F.col("doc_id") != 3, F.length("text").cast("long")))
        assert _manifest(docs, levels) == _plain_manifest([tuple(r) for r in docs.select(*COLUMNS).collect()])


def test_manifest_of_many_rows_and_of_none(spark, empty_docs):
    docs = spark.range(777).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(
        F.concat(F.lit("l"), F.col("id") % 5)).alias("lang"), F.lit(2**63 - 1).alias("n_chars"), F.lit("t").alias("text"))
    got = _manifest(docs, 3)
    assert got == _plain_manifest([tuple(r) for r in docs.collect()]) and 0 < sum(not r[-1] for r in got) < 777
    assert _manifest(empty_docs.withColumn("n_chars", F.lit(1))) == []


def test_sweeps_of_one_block():
    for n in range(1, 40):
        leaves = [_h(str(i)) for i in range(n)]
        top, nodes = merkle.sweep_up(leaves, (n - 1).bit_length())
        up = leaves
        while len(up) > 1:
            up = [_h(*up[k:k + 2]) for k in range(0, len(up), 2)]
        assert top == up[0] and [x for x in nodes] == sorted(nodes, key=lambda x: (min((x[1] + 1 << x[0]) - 1, n - 1), x[0]))
        for leaf, suffix in zip(leaves, merkle.sweep_down(nodes, "", n), strict=True):
            assert merkle.folded(leaf, suffix) == top


# --- filter audit -----------------------------------------------------------------------------

def _plain_audit(rows, labels):
    """{(part, order, step): (kept, removed, redundant, unique, good, toxic, shapley)} of rows (doc_id, lang, text)."""
    best = {}
    for i, q, t in labels:
        if i is not None:
            old = best.get(i, (0, 0))
            best[i] = (max(old[0], q or 0), max(old[1], t or 0))
    judged = []
    for i, lang, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {c for c, bad in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                                              100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)))) if bad}
        if i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in rows):
            fails.add("E")
        judged.append((lang or "", fails, *best.get(i, (0, 0))))
    out, shapley = {}, {}
    for part in {p for p, *_ in judged}:
        mine = [x for x in judged if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                out[part, order, k + 1] = [len(left), len(gone), sum(c in x[1] for x in mine) - len(gone), sum(x[1] == {c} for x in mine),
                                           sum(x[2] == 1 for x in gone), sum(x[3] == 1 for x in gone)]
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _audited(docs, labels):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in audit.audit(docs, labels).collect()}


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (9, 1, 0), (10, None, 1), (None, 1, 1), (77, 1, 1)]


def test_audit_equals_a_plain_one(spark, edge_docs, edge_rows, clashing, empty_docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = _plain_audit([(i, lang, text) for i, text, lang, _ in edge_rows], LABELS)
    assert _audited(edge_docs, labels) == want and _audited(clashing, labels) == want
    assert _audited(empty_docs, labels) == {}
    assert _audited(edge_docs, labels.filter("false")) == _plain_audit([(i, lang, text) for i, text, lang, _ in edge_rows], [])


def test_audit_with_a_hot_text_and_a_hot_id(spark):
    rows = [(i % 40, "en" if i % 2 else None, "one and the same text") for i in range(300)] + [(5, "en", f"text {i} #") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    labels = [(5, 1, 1), (6, 0, 1)]
    assert _audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == _plain_audit(rows, labels)


def test_carry_save_counts_and_survival_words():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 8, 9, 100, 4097):
        words = r.integers(0, 1 << 32, n, dtype=np.uint32)
        assert audit.positional_popcount(words).tolist() == [int((words >> np.uint32(k) & np.uint32(1)).sum()) for k in range(32)]
    for fails in range(32):
        word = (1 << 32) - 1
        for i in range(5):
            word &= audit.LACKS[i] if fails >> i & 1 else (1 << 32) - 1
        assert all((word >> s & 1) == (s & fails == 0) for s in range(32))


def test_look_up_keeps_every_row(spark, tmp_path):
    spark.createDataFrame([(None if i % 5 == 0 else i % 3, i) for i in range(90)], "k long, v long").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    values = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k long, x string")
    got = look_up(rows, ["k"], values, 4).collect()
    assert sorted((r.v, r.k, r.x) for r in got) == [(i, None if i % 5 == 0 else i % 3, None if i % 5 == 0 else {0: "a", 1: "b"}.get(i % 3)) for i in range(90)]

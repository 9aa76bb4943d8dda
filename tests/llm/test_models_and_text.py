"""Learned operators on held-out rows; token round trips and parity; the mix, URLs, chats and top-k against plain versions."""

import hashlib
import math
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from riskkit.llm import chat_format as chat
from riskkit.llm import exact_topk as topk
from riskkit.llm import language_crf as crf
from riskkit.llm import quality as q
from riskkit.llm import sentence_pieces as sp
from riskkit.llm import source_mix as sm
from riskkit.llm import url_filter as url
from riskkit.llm.catalog import QUERIES


# --- quality -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def quality_rows(spark):
    return QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").toPandas()


def test_quality_on_held_out_rows(spark, quality_rows):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    rows = quality_rows.merge(labels, on="doc_id")
    rows = rows[rows.held_out]
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert ((rows.predicted == rows.quality).mean()) > 0.9
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_quality_edges(spark, edge_docs, edge_rows, empty_docs, clashing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.fit_quality(edge_docs, labels)
    for docs in (edge_docs, clashing):
        scores = docs.select("doc_id", model.score(F.col("text")).alias("v")).collect()
        assert len(scores) == len(edge_rows) and all(0 <= r.v <= 1 for r in scores)
    assert q.fit_quality(empty_docs, labels).network.prior == 0.5
    none = q.fit_quality(edge_docs, labels.filter("false"))
    assert {r.v for r in edge_docs.select(none.score(F.col("text")).alias("v")).collect()} == {0.5}
    assert empty_docs.select(model.score(F.col("text")).alias("v")).count() == 0


def test_word_vectors_do_not_depend_on_the_order_of_rows(real_docs):
    shape = q.Indexing(buckets=256, dims=16)
    a = q.word_vectors(real_docs.repartition(2), "text", shape)
    assert np.array_equal(a, q.word_vectors(real_docs.repartition(7), "text", shape))


def test_neighbourhoods_match_a_plain_count():
    shape, texts = q.Indexing(buckets=8, dims=4), ["a b c!", "", "b b", "é a"]
    h, counts = q.tokens(*q.text_bytes(pa.array(texts)))
    assert counts.tolist() == [4, 0, 2, 2]
    got = np.zeros((8, 5), np.int64)
    shape.add(got, h, counts)
    want, at = np.zeros((8, 5), np.int64), 0
    place, sign = shape.index_vectors(h)
    for n in counts:
        for i in range(at, at + n):
            want[shape.rows(h)[i], 4] += 1
            for j in range(max(at, i - 2), min(at + n, i + 3)):
                if j != i:
                    for p, s in zip(place[:, j], sign[:, j]):
                        want[shape.rows(h)[i], p] += int(s)
        at += n
    assert np.array_equal(got, want)


# --- language -------------------------------------------------------------------------

def test_language_on_held_out_rows(spark):
    rows = QUERIES["op7_language_crf"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    rows = rows.merge(docs, on="doc_id")
    assert (rows[rows.held_out].lang == rows[rows.held_out].lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_language_edges(spark, edge_docs, edge_rows, empty_docs, clashing):
    model = crf.fit_languages(edge_docs)
    assert model.langs == ("de", "en", "fr")
    for docs in (edge_docs, clashing):
        rows = docs.select("text", model.identify(F.col("text")).alias("x")).collect()
        assert len(rows) == len(edge_rows)
        for r in rows:
            letters = r.text is not None and any(c.isalpha() for c in r.text)
            assert (r.x.lang_pred != "und") == letters and 0 <= r.x.score <= 1
    nothing = crf.fit_languages(empty_docs)
    assert {r.x.lang_pred for r in edge_docs.select(nothing.identify(F.col("text")).alias("x")).collect()} == {"und"}
    assert empty_docs.select(model.identify(F.col("text")).alias("x")).count() == 0


def test_posteriors_are_exact_on_long_and_short_chains():
    r = np.random.default_rng(0)
    counts = np.array([1, 2, 63, 64, 65, 200, 3])
    emit, moves = r.normal(size=(counts.sum(), 3)), r.normal(size=(3, 3))
    got, at = crf.posteriors(emit, moves, counts), 0
    for n in counts:
        e = np.exp(emit[at:at + n])
        fore, back = [np.ones(3) * e[0] * np.exp(moves).sum(0)], [np.ones(3)]
        for t in range(1, n):
            x = (fore[-1] @ np.exp(moves)) * e[t]
            fore.append(x / x.sum())
        for t in range(n - 1, 0, -1):
            x = np.exp(moves) @ (e[t] * back[-1])
            back.append(x / x.sum())
        p = np.array(fore) * np.array(back[::-1])
        assert np.allclose(got[at:at + n], p / p.sum(1, keepdims=True), atol=1e-9)
        at += n


def test_code_switched_words_get_their_own_language(spark):
    rows = [(i, " ".join(random.Random(i).choices(["the", "house", "is", "while"], k=30)), "en") for i in range(40)]
    rows += [(100 + i, " ".join(random.Random(i).choices(["das", "haus", "ist", "während"], k=30)), "de") for i in range(40)]
    model = crf.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    w = crf.Words.of(pa.array(["the house is während das haus ist the while"]))
    best = crf.posteriors(model.emissions(w), model.moves, w.counts).argmax(1)
    assert [model.langs[k] for k in best] == ["en"] * 3 + ["de"] * 4 + ["en"] * 2


# --- sentence pieces ----------------------------------------------------------------

def proto(pieces, model_type, byte_fallback=1, dummy=1, squeeze=0):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def sub(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    out = b""
    for piece, score, kind in pieces:
        out += sub(1, sub(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(kind))
    out += sub(2, b"\x18" + varint(model_type) + varint(35 << 3) + varint(byte_fallback) + varint(4 << 3) + varint(len(pieces)))
    return out + sub(3, sub(1, b"identity") + varint(3 << 3) + varint(dummy) + varint(4 << 3) + varint(squeeze) + varint(5 << 3) + b"\x01")


def adversarial(seed, alphabet, n=600):
    r = random.Random(seed)
    return ["", " ", "  a", "a ", "\n\t", *("".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(n))]


def same_as_library(model, library, texts):
    ids, bounds = model.encode(pa.array(texts, pa.string()))
    want = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert model.decode(ids.astype(np.int64), bounds) == library.decode(want)


def test_parity_with_the_model_file(real_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    model = sp.PieceModel.load()
    assert model.by_words() and not model.unigram and model.byte_fallback
    same_as_library(model, library, [r.text for r in real_docs.select("text").collect()])
    same_as_library(model, library, adversarial(1, list(" abe▁\n<s>0x日tHé😀") + ["  ", "</s>", "<0x0A>", "the "], 3000))


@pytest.mark.parametrize("squeeze", [0, 1])
def test_parity_of_a_unigram_model(squeeze):
    base = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces = base + [(p, -s, 1) for p, s in (("▁", 2.013), ("a", 3.1107), ("b", 3.3309), ("c", 3.7031), ("ab", 4.2253), ("▁a", 3.9401),
                                        ("bc", 5.0523), ("▁ab", 5.9717), ("abc", 6.1611), ("ca", 5.3071))]
    data = proto(pieces, 1, squeeze=squeeze)
    same_as_library(sp.PieceModel.parse(data), sentencepiece.SentencePieceProcessor(model_proto=data), adversarial(2, list("abc abcé")))


def test_pieces_across_words_are_encoded_text_by_text():
    base = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces = base + [(p, float(-i), 1) for i, p in enumerate(["a▁", "▁a", "a▁b", "ab", "▁", "a", "b"])]
    data = proto(pieces, 2)
    model = sp.PieceModel.parse(data)
    assert not model.by_words()
    same_as_library(model, sentencepiece.SentencePieceProcessor(model_proto=data), adversarial(3, list("aab ")))


def test_encoded_column_and_edges(edge_docs, edge_rows, empty_docs, clashing):
    model = sp.PieceModel.load()
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    rows = sp.coded(clashing, model).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids) and r["size"] == "x"
        assert r.lossless == ("▁" not in (r.text or ""))
    assert sp.coded(empty_docs, model).count() == 0


def test_checked_pass_and_a_full_word_table(spark, edge_docs, edge_rows, monkeypatch):
    model = sp.PieceModel.load()
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    rows = sp.checked(edge_docs, model).collect()
    assert len(rows) == len(edge_rows) and "text" not in rows[0]
    text = {(i, s): t for i, t, _, s in edge_rows}
    for r in rows:
        t = text[r.doc_id, r.source] or ""
        back = library.decode(library.encode(t))
        assert r.ids == library.encode(t) and r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest() and r.lossless == (back == t)
    # words in tables that hold few of them, and texts in small pieces, give the same ids
    column = pa.array([t or "" for _, t, _, _ in edge_rows])
    want = model.encode(column)
    monkeypatch.setattr(sp, "CHUNK_BYTES", 300)
    for limit in (1, 50, 10_000):
        words = sp.WordTable(limit)
        for got in (model.encode(column, words), model.encode(column, words)):
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_samples_hold_for_null_and_repeated_ids(spark, real_docs):
    """A third of the rows under a null id, and a third under one id: no flood into either sample."""
    docs = real_docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 1, F.lit(None)).when(F.col("doc_id") % 3 == 2, F.lit(3)).otherwise(F.col("doc_id")))
    per = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    drawn = crf.sample_spans(docs.select("doc_id", "text", "lang"), per, 10, 16, 1)
    assert len(drawn) < 3 * 10 * len(per)
    copies = docs.limit(1).select("doc_id", "text", "lang").crossJoin(spark.range(500)).drop("id")
    assert len(crf.sample_spans(copies, {r["lang"]: 1 for r in copies.limit(1).collect()}, 10, 16, 1)) <= 1
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)], "doc_id long, quality int")
    seen = []
    q_train, q.train = q.train, lambda x, y, **k: seen.append(len(y)) or q_train(x, y, **k)
    try:
        q.fit_quality(docs, labels, max_rows=15)
    finally:
        q.train = q_train
    assert seen == [15]


def test_decoder_of_the_library_agrees():
    model = sp.PieceModel.load()
    tok = model.tokenizer()
    for text in ["The river, of stone.", "日本語 é", "a  b"]:
        ids = model.encode(pa.array([text]))[0]
        assert tok.decode(ids.tolist(), skip_special_tokens=False) == text


# --- mixing --------------------------------------------------------------------------

def plain_targets(sizes):
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix_reaches_its_targets(edge_docs, edge_rows, clashing, real_docs, empty_docs):
    for docs, rows in ((edge_docs, [(d, t, s) for d, t, _, s in edge_rows]), (clashing, [(d, t, s) for d, t, _, s in edge_rows]),
                       (real_docs, [(r.doc_id, r.text, r.source) for r in real_docs.collect()])):
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        want = plain_targets(sizes)
        got = sm.mix(docs).collect()
        assert len(got) == len(rows)
        assert sorted((r.doc_id is None, r.doc_id, r["size"]) for r in got) == sorted(
            (d is None, d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _ in rows)
        taken = {}
        for r in got:
            assert 0 <= r.taken <= 3 * r["size"]
            key = (r.source_size, round(r.target, 6))
            taken[key] = taken.get(key, 0) + r.taken
        for s, size in sizes.items():
            assert any(k == (size, pytest.approx(want[s], abs=1e-4)) for k in taken)
        total = {}
        for s, size in sizes.items():
            k = (size, round(want[s], 6))
            total[k] = total.get(k, 0) + math.floor(want[s] + 1e-9)
        assert sum(taken.values()) == pytest.approx(sum(total.values()), abs=len(sizes))
        for k, v in total.items():
            near = min(taken, key=lambda x: abs(x[0] - k[0]) + abs(x[1] - k[1]))
            assert abs(taken[near] - v) <= len(sizes)
    assert sm.mix(empty_docs).count() == 0


def test_schedule_is_spread_evenly(real_docs):
    sizes = sm.sized(real_docs)
    per = sm.targets(sizes).cache()
    n = 4000
    rows = sm.schedule(sm.quotas(per, 8), n).filter("slot IS NOT NULL").collect()
    share = {r.s: r.target for r in per.collect()}
    total = sum(share.values())
    for s in share:
        slots = sorted(r.slot for r in rows if r.s == s)
        assert [r.rank for r in sorted((r for r in rows if r.s == s), key=lambda r: r.slot)] == list(range(len(slots)))
        for at in (500, 1000, 2000):
            if len(slots) and slots[-1] > at:
                assert abs(sum(x < at for x in slots) - at * share[s] / total) < 6


# --- URLs ----------------------------------------------------------------------------

def test_urls_edges(spark):
    rows = ["https://a.example.NET/en/1?x#y", None, "", "no scheme.net/", "http://net/", "http://net", "x://org/fr/1", "http://sub.org/fr/", "http://xorg/fr/",
            "http://example.com/de/é", "http://example.com/den", "http://a.net:80/", "://b.net/", "http://ünet/", "http://a.example.com?u=http://b.net/",
            "http://c.net/a\nb", "http://c.net/a\nb", "HTTP://EXAMPLE.NET/EN/", "http://" + "a." * 5000 + "net/" + "p/" * 5000]
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(rows)], "page_id long, url string, host string, rule string")

    def plain(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in url.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        return host, path, best and best.text, best.verdict if best else "allow"

    got = url.filter_urls(frame, url.RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [plain(u) for u in rows]
    assert url.filter_urls(frame.filter("false"), url.RULES).count() == 0
    assert {r.verdict for r in url.filter_urls(frame, []).collect()} == {"allow"}


def test_rules_stand_under_their_rarest_token():
    rules = [url.UrlRule("example.net/en/", "allow"), url.UrlRule("net/", "block"), url.UrlRule("org/x", "block")]
    assert rules[0].tokens() == ["example", "net", "en"] and rules[2].tokens() == ["org"]
    assert url.rule_index(rules, {"example": 9, "net": 5, "en": 2, "org": 1}) == {"en": [0], "net": [1], "org": [2]}


# --- chats ---------------------------------------------------------------------------

def test_chats_round_trip(spark):
    texts = [chat.PROBE, "", None, "<|im_start|>x<|im_sep|>\\-<|im_end|>", "\\\\[INST]\\", "[[INST]", "<<SYS>></SYS>> <</SYS>>", "é日本語😀 " * 3000, "plain"]
    rows = [(c, t, role, texts[(c * 3 + t) % len(texts)], "x") for c in range(6) for t, role in enumerate(["system", "user", "assistant", "assistant", None])]
    rows += [(None, 0, "assistant", "no id", "x"), (7, None, "user", "b", "x"), (7, 0, "user", "a", "x"), (7, 0, "user", "a", "x"), (8, 0, "assistant", None, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string").repartition(3)
    formatted = chat.format_chats(frame)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == 9
    for c, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text, _ in rows if k == c))
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == digest("".join(f"{role}\n{text}\n" for *_, role, text in turns))
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), digest(loss))
    for r in formatted.collect():
        inside = re.split(r"<\|im_(?:start|sep|end)\|>", r.text)
        assert not any(x in part for part in inside for x in chat.CONTROL)
        assert r.text.count(chat.START) == sum(k == r.conv_id for k, *_ in rows)
        assert len(r.ids) == len(r.loss_mask) and set(r.loss_mask) <= {0, 1}
    assert chat.format_chats(frame.filter("false")).count() == 0


def test_escapes_are_reversible():
    r, t = random.Random(0), chat.ChatTemplate()
    for _ in range(3000):
        s = "".join(r.choice(["\\", "-", "[", "<", "INST]", "/", "s>", *chat.CONTROL]) for _ in range(r.randint(0, 12)))
        assert t.unescape(t.escape(s)) == s and not any(c in t.escape(s) for c in chat.CONTROL)


# --- top-k ---------------------------------------------------------------------------

def test_topk_matches_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.repeat(r.normal(size=(60, 5)), 5, axis=0))]  # ties: each vector five times
    rows += [(400, [1.0] * 5), (400, [1.0] * 5), (450, None), (500, [1.0, None, 1.0, 1.0, 1.0]), (550, [float("nan")] * 5), (600, [1.0, 2.0]),
             (650, [3.0, float("inf")]), (700, []), (None, [9.0] * 5), (750, [0.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    whole = frame.filter(topk.usable(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda x: F.floor(x * 256).cast("long")).alias("v"))
    ok = [(i, tuple(math.floor(x * 256) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for qi, qv in {(i, v) for i, v in ok if i % 50 == 0}:
        near = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != qi and len(v) == len(qv))[:5]
        want += [(qi, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    for tree_rows in (4096, 40):
        got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in topk.exact_topk(whole, F.col("vec_id") % 50 == 0, 5, tree_rows).collect()]
        assert sorted(got) == sorted(want)
    assert topk.exact_topk(whole.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_stored_distances_spare_computations():
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 8)) * 400
    points = np.rint(np.repeat(centres, 100, axis=0) + r.normal(size=(4000, 8)) * 5).astype(np.int64)
    tree = topk.MTree.of(points, np.arange(4000))
    for i in range(0, 4000, 500):
        best, computed = tree.search(points[i], i, 5)
        want = sorted(((int(s), -j) for j, s in enumerate(points @ points[i]) if j != i), reverse=True)[:5]
        assert best == want and computed < 1500


def test_a_hot_id_is_dealt_over_many_trees(spark):
    r = np.random.default_rng(2)
    v = r.integers(-50, 50, (300, 6))
    rows = [(0 if i % 3 == 0 else i, v[i].tolist()) for i in range(300)] + [(7, v[7].tolist())] * 40
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(4)
    got = {}
    for x in topk.exact_topk(vectors, F.col("vec_id").isin(7, 50), k=4, tree_rows=32).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    for q in (7, 50):
        want = sorted(((-int(v[q] @ np.array(w)), i) for i, w in rows if i != q))[:4]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    parts = topk.search_partitions(vectors.selectExpr("vec_id AS id", "v"), vectors.limit(0).selectExpr("vec_id AS id", "v", "0L AS qkey"), 1, 8)
    assert parts.count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [1.0, None]), (3, [0.5, 2.0])], "vec_id long, e array<double>")
    assert [x.vec_id for x in huge.filter(topk.usable(F.col("e"))).collect()] == [3]

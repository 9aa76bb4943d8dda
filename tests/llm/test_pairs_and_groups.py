"""SimHash groups, SpotSigs fingerprints and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from riskkit.llm import simhash_groups as sim
from riskkit.llm import spot_signatures as spot
from riskkit.llm import suffix_dedup as suf
from riskkit.llm.components import components


def simhash(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def linked(fps, max_bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket_rows", [64, 1])
def test_simhash_groups_match_brute_force(edge_docs, edge_rows, bucket_rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component_id) for r in
                 sim.near_duplicate_groups(edge_docs, 3, 2, bucket_rows).collect())
    fps = [simhash(t) for _, t, _, _ in edge_rows]
    roots = linked(fps, 2)
    least = {r: min((d for (d, *_), q in zip(edge_rows, roots) if q == r and d is not None), default=None) for r in roots}
    assert got == sorted((d if d is not None else -1, f, least[r]) for (d, *_), f, r in zip(edge_rows, fps, roots))


@pytest.mark.parametrize("max_bits,bucket_rows", [(0, 64), (1, 64), (2, 64), (3, 64), (5, 64), (2, 1), (3, 1)])
def test_links_connect_all_close_fingerprints(spark, max_bits, bucket_rows):
    r = random.Random(max_bits)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    edges = sim.links(frame, max_bits, bucket_rows).collect()
    assert all(bin((e.u ^ e.v) % 2**64).count("1") <= max_bits for e in edges)
    at = {f: i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = find(at[e.u % 2**64]), find(at[e.v % 2**64])
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == linked(fps, max_bits)


def test_allotment_obeys_the_pigeonhole_sum():
    both = np.full((64, 64), 25.0) + np.eye(64) * 25
    for parts in range(1, 6):
        groups = sim.bit_partitions(100, both, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, chosen = sim.allot(100, both, groups, 2)
        assert sum(chosen) == 2 - parts + 1 and all(t >= -1 for t in chosen)


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, **{200 + i: 200 for i in range(9)}}


def test_empty_and_clashing(spark, empty_docs, clashing, edge_docs, edge_rows):
    assert sim.near_duplicate_groups(empty_docs).count() == 0
    assert suf.remove_repeats(empty_docs.select("doc_id", "text")).count() == 0
    assert spot.edited_texts(empty_docs).count() == 0
    assert sim.near_duplicate_groups(clashing).count() == len(edge_rows)
    assert spot.edited_texts(clashing).count() == len(edge_rows)
    out = suf.remove_repeats(clashing)
    assert out.count() == len(edge_rows) and "rest" in out.columns and out.columns.count("n_bytes") == 1


# --- SpotSigs -------------------------------------------------------------------

def spots(text, chain=2):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]
    content = [w for w in words if w not in spot.ANCHORS]
    out, seen = [], 0
    for w in words:
        if w in spot.ANCHORS:
            out.append((w, *content[seen:seen + chain]))
        else:
            seen += 1
    return words, content, out


def test_signatures_match_a_plain_walk(spark, edge_rows):
    from pyspark.sql import functions as F
    texts = sorted({t for _, t, _, _ in edge_rows if t})
    rows = []
    for i, t in enumerate(texts):
        words, content, chains = spots(t)
        rows += [(i, True, *(list(c) + [None, None])[:3]) for c in chains]
        rows += [(i, False, *(content[k:k + 3] + [None, None])[:3]) for k in range(len(content))]
    frame = spark.createDataFrame(rows, "i int, common boolean, a string, b string, c string")
    want = {i: set() for i in range(len(texts))}
    for r in frame.filter(F.col("common") | (F.hash("a") % 8 == 0)).select("i", F.hash("a", "b", "c").alias("h")).collect():
        want[r.i].add(r.h)
    whole = spark.createDataFrame([(i, " ".join(spots(t)[0])) for i, t in enumerate(texts)], "i int, w string").select("i", F.hash("w").alias("h")).collect()
    want = {r.i: want[r.i] or {r.h} for r in whole}
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", spot.signatures(F.col("t")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: sorted(s) for i, s in want.items()}


def test_edits_and_likeness(edge_docs, edge_rows):
    from pyspark.sql import functions as F
    rows = spot.edited_texts(edge_docs).select("doc_id", "n_chars", "edited", "sigs", spot.likeness(F.col("sigs"), F.col("sigs")).alias("same")).collect()
    assert len(rows) == len(edge_rows) and all(r.same == 1.0 for r in rows)
    ids = sorted({d for d, *_ in edge_rows if d is not None}, reverse=True) + [None]
    text = {}
    for d, t, _, _ in edge_rows:
        text.setdefault(d, []).append(t or "")
    for r in rows:
        after = ids[(ids.index(r.doc_id) + 1) % len(ids)]
        options = {t[:len(t) - len(t) // 3] + min(text[after], key=lambda x: x.encode())[:len(t) // 3] for t in text[r.doc_id]}
        assert r.edited in options
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.n_chars), set()).add(tuple(r.sigs))
    assert by[(1, len(edge_rows[0][1]))] == by[(2, len(edge_rows[0][1]))]


def test_near_duplicates_of_signature_sets(real_docs):
    from pyspark.sql import functions as F
    sets = {r.doc_id: frozenset(r.s) for r in real_docs.select("doc_id", spot.signatures(F.col("text")).alias("s")).collect()}
    got = {r.doc_id: r.class_id for r in spot.near_duplicates(real_docs, 0.8).collect()}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in ids}


# --- repeated passages ------------------------------------------------------------

def without_repeats(rows, length):
    """(id, text) -> n_bytes, n_removed, n_spans, kept; rows repeated in full are one document."""
    seen, out = {}, {}
    order = sorted({(d if d is not None else 2**63, t or "") for d, t in rows})
    starts = sorted((d, s, t) for d, t in order for s in range(max(0, len(t.encode()) - length + 1)))
    gone = {(d, t): np.zeros(len(t.encode()), bool) for d, t in order}
    for d, s, t in starts:
        w = t.encode()[s:s + length]
        first = seen.setdefault(w, (d, s))
        if first != (d, s):
            gone[d, t][s:s + length] = True
    for d, t in order:
        g, b = gone[d, t], np.frombuffer(t.encode(), np.uint8)
        out[d, t] = (len(b), int(g.sum()), int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum()), hashlib.sha256(b[~g].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("variants,bucket_rows", [(512, 4096), (1, 4096), (512, 2)])
def test_repeats_match_brute_force(spark, edge_rows, variants, bucket_rows):
    r = random.Random(5)
    base = edge_rows[0][1]
    rows = [(d, t[:3000] if t else t) for d, t, _, _ in edge_rows]
    for i in range(20, 50):  # near copies: a change here and there
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("qzé")
        rows.append((i, "".join(t[r.randint(0, 40):])))
    want = without_repeats(rows, 100)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = suf.remove_repeats(frame, 100, variants, bucket_rows).collect()
    assert len(out) == len(rows)
    got = sorted((x.doc_id if x.doc_id is not None else 2**63, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in out)
    assert got == sorted((d if d is not None else 2**63, *want[d if d is not None else 2**63, t or ""]) for d, t in rows)


@pytest.mark.parametrize("variants", [4096, 1])
def test_many_texts_of_one_id_are_told_apart(spark, variants):
    from pyspark.sql import functions as F
    r = random.Random(8)
    rows = []
    for i in range(5000):  # 20 bits tell some 1,200 texts apart; every text has a repeat of its own, every other one shares one
        own, shared = r.randbytes(70).hex(), random.Random(i // 2).randbytes(60).hex()
        rows.append((None if i % 4 < 2 else 7, r.randbytes(3 + i % 41).hex() + own + "-" * (1 + i % 7) + own + shared[:100 + i % 20]))
    want = without_repeats(rows, 100)
    out = suf.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("t", F.col("text")), 100, variants).collect()
    assert len(out) == len(rows) and all(x.n_removed >= 140 for x in out)
    got = {(x.doc_id, x.t): (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in out}
    assert got == {(d, t): want[d or 2**63, t] for d, t in rows}


@pytest.mark.parametrize("length", [32, 64, 200])
def test_other_lengths(spark, length):
    r = random.Random(length)
    rows = [(i, "".join(r.choice("ab") for _ in range(40)) * r.randint(1, 9) + "x" * i) for i in range(25)]
    want = without_repeats(rows, length)
    out = suf.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    assert {(x.doc_id, x.n_bytes, x.n_removed, x.n_spans) for x in out} == {(d, *want[d, t][:3]) for d, t in rows}


def test_merged_blocks_are_the_blocks_of_equal_prefixes():
    r = np.random.default_rng(1)
    texts = [r.integers(1, 4, r.integers(1, 7)) for _ in range(60)]
    built, at, n = [], [], []
    for shard in np.array_split(np.arange(60), 3):
        symbol = np.concatenate([texts[i] for i in shard])
        string = np.repeat(np.arange(len(shard)), [len(texts[i]) for i in shard])
        t, rows = suf.transform(symbol, string, len(shard))
        built.append(t)
        n.append(len(shard))
        place = [(i, k) for i in shard for k in range(len(texts[i]))]
        at.append([place[x] if x >= 0 else None for x in rows])
    for rounds in (1, 2, 3):
        shard, block = suf.merged_blocks(built, n, rounds)
        prefix, use = [], [iter(a) for a in at]
        for s in shard:
            p = next(use[s])
            prefix.append(() if p is None else tuple([*texts[p[0]][p[1]:], 0, 0, 0][:rounds]))
        ends = [p for p in prefix if p == ()]
        assert prefix[:len(ends)] == ends
        # an end compares equal to any end; what follows it is not looked at
        cut = [p[:p.index(0) + 1] if 0 in p else p for p in prefix]
        assert cut == sorted(cut)
        assert [block[i] != block[i - 1] for i in range(1, len(cut))] == [cut[i] != cut[i - 1] for i in range(1, len(cut))]


def test_kept_text_drops_split_characters(spark):
    a = "é" * 60
    out = suf.remove_repeats(spark.createDataFrame([(1, a), (2, "z" + a[:55] + "日本")], "doc_id long, text string"), 100, as_text=True)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].kept.startswith("z") and rows[2].kept.endswith("日本") and "�" not in rows[2].kept


def test_components_of_a_hub_and_of_long_chains(spark):
    from riskkit.llm.components import components
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (7000, 7001), (7001, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    want = {**{i: 0 for i in range(400)}, **{1000 + i: 1000 for i in range(61)}, 7000: 7000, 7001: 7000}
    assert got == want


def test_likeness_columns_equal_plain_jaccard(spark):
    from riskkit.llm.catalog import QUERIES
    rows = sorted(QUERIES["op2_spot_signatures"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: -r.doc_id)
    sets = lambda text: {text[i:i + 8] for i in range(0, len(text), 8)}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    for at, r in enumerate(rows):
        own = sets(r.fingerprint)
        assert own and abs(r.near_edited - jaccard(own, sets(r.edited_fingerprint))) < 1e-12
        assert abs(r.near_next - jaccard(own, sets(rows[(at + 1) % len(rows)].fingerprint))) < 1e-12

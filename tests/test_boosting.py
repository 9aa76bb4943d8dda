"""Boosted trees against plain versions: split gains, shared scans, both ways of growing a node, patience, softmax; isotonic steps."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskkit.operators import boosting as B
from riskkit.operators import isotonic as iso
from riskkit.operators import models as L


def _rows(n, width=5, seed=0, gaps=0.1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width))
    x[:, -1] = x[:, -1] > 0.3
    y = (x[:, 0] + x[:, -1] - 0.5 * x[:, 1] + 0.7 * r.normal(size=n) > 0).astype(float)
    x[r.random((n, width)) < gaps] = np.nan
    return x, y


def _frame(spark, x, y, parts=3, folds=3):
    schema = T.StructType([T.StructField("SEQN", T.LongType()), T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType()),
                           T.StructField("fold", T.IntegerType())])
    return spark.createDataFrame([(i, Vectors.dense(v.tolist()), float(t), i % folds) for i, (v, t) in enumerate(zip(x, y))], schema).repartition(parts)


def _bins(x, k=16):
    return B.Bins(tuple(tuple(sorted({float(v) for v in np.nanquantile(c, np.arange(1, k) / k, method="lower") if v < np.nanmax(c)})) for c in x.T))


def _plain_best(x, g, h, bins, l2=1.0, least=1.0):
    """(gain, feature, bin, missing left) by trying every cut on the raw rows."""
    best = None
    root = g.sum() ** 2 / (h.sum() + l2)
    for side in (False, True):
        for f, edges in enumerate(bins.edges):
            for b, e in enumerate(edges):
                left = np.where(np.isnan(x[:, f]), side, x[:, f] <= e)
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                if hl < least or hr < least:
                    continue
                gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - root
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, b, side)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_split_gains_equal_a_plain_search(seed):
    x, y = _rows(300, seed=seed)
    bins = _bins(x)
    r = np.random.default_rng(seed)
    p = r.random(300)
    g, h = p - y, p * (1 - p)
    tree = B.grown(bins.of(x), g, h, bins, B.Boosting(), np.ones(5, bool), 3)
    nodes = {0: np.ones(300, bool)}
    for k, n in enumerate(tree):
        mine = nodes[k]
        assert np.isclose(n["value"], -g[mine].sum() / (h[mine].sum() + 1))
        if n["feature"] >= 0:
            want = _plain_best(x[mine], g[mine], h[mine], bins)
            assert np.isclose(n["gain"], want[0]) and (n["feature"], n["bin"], n["missing_left"]) == want[1:]
            v = x[:, n["feature"]]
            left = np.where(np.isnan(v), n["missing_left"], v <= bins.edges[n["feature"]][n["bin"]])
            nodes[n["left"]], nodes[n["right"]] = mine & left, mine & ~left


def test_pruning_takes_weak_splits_from_the_bottom():
    x, y = _rows(400, seed=3)
    bins = _bins(x)
    full = B.grown(bins.of(x), 0.5 - y, np.full(400, 0.25), bins, B.Boosting(), np.ones(5, bool), 5)
    cut = B.pruned(full, 3.0)
    assert 1 < len(cut) < len(full)
    inner = cut[cut["feature"] >= 0]
    for n in inner:  # what stays under the bound has a split below it
        assert n["gain"] >= 3.0 or (cut["feature"][[n["left"], n["right"]]] >= 0).any()
    assert len(B.pruned(full, 1e9)) == 1 and np.array_equal(B.pruned(full, 0.0), full)


def _plain_boost(x, y, bins, spec, rounds):
    z, codes, missing = np.zeros(len(y)), bins.of(x), bins.sizes - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = B.grown(codes, p - y, p * (1 - p), bins, spec, np.ones(len(bins.edges), bool), spec.depth)
        z = z + spec.step * tree["value"][B.routed(tree, codes, missing)]
    return z


@pytest.mark.parametrize("in_task", [1 << 17, 150, 0])
def test_fit_equals_a_plain_loop_whichever_way_nodes_are_grown(spark, in_task):
    x, y = _rows(500)
    bins, spec = _bins(x), B.Boosting(rounds=6, depth=3, step=0.3, subsample=1.0)
    models, _ = B.fit_all(_frame(spark, x, y), [spec], bins=bins, in_task=in_task, histogram_bytes=1 << 14)
    z = models[0].margin_of_bins(bins.of(x))[:, 0]
    assert np.allclose(z, _plain_boost(x, y, bins, spec, 6), atol=1e-9)


def test_models_grown_together_equal_single_fits(spark):
    x, y = _rows(400, seed=1)
    df, bins = _frame(spark, x, y), _bins(x)
    specs = [B.Boosting(rounds=r, depth=d, step=0.2, subsample=s, columns=c, min_gain=m, held_fold=f)
             for r, d, s, c, m, f in ((3, 2, 0.8, 1.0, 0.0, 0), (7, 4, 1.0, 0.6, 0.5, 1), (5, 3, 0.7, 0.8, 0.1, -1))]
    together, rows = B.fit_all(df, specs, fold="fold", bins=bins, scorer=B.recall_by_fold, scores="lane int, positives long, found long")
    codes = bins.of(x)
    for i, s in enumerate(specs):
        alone = B.fit_all(df, [s], fold="fold", bins=bins)[0][0]
        assert len(alone.trees[0]) == s.rounds and np.allclose(alone.margin_of_bins(codes), together[i].margin_of_bins(codes), atol=1e-9)
        held = (np.arange(400) % 3 == s.held_fold) & (y == 1)
        got = next(r for r in rows if r["lane"] == i)
        assert (got["positives"], got["found"]) == (held.sum(), (together[i].margin_of_bins(codes)[held, 0] >= 0).sum())


def test_a_held_out_fold_is_not_learned_from(spark):
    x, y = _rows(300, seed=4)
    bins, spec = _bins(x), B.Boosting(rounds=3, depth=3, held_fold=2, subsample=1.0)
    spoiled = np.where(np.arange(300) % 3 == 2, 1 - y, y)
    a, b = (B.fit_all(_frame(spark, x, t), [spec], fold="fold", bins=bins)[0][0] for t in (y, spoiled))
    assert np.allclose(a.margin_of_bins(bins.of(x)), b.margin_of_bins(bins.of(x)), atol=1e-12)


def test_rounds_stop_by_patience_on_the_validation_rows(spark):
    x, y = _rows(400, seed=5)
    r = np.random.default_rng(5)
    y = np.where(r.random(400) < 0.3, 1 - y, y)  # noise, so that the loss turns
    df = _frame(spark, x, y).withColumn("judge", F.col("fold") == 2)
    model = L.gbt(rounds=60, depth=5, step=0.3, subsample=1.0, validation="judge", patience=4).fit(df).ensemble
    losses, kept = np.array(model.losses), len(model.trees[0])
    want = next((k for k in range(1, 61) if k - (int(losses[:k].argmin()) + 1) >= 4), 60) if len(losses) else 0
    assert len(losses) == want < 60 and kept == int(losses.argmin()) + 1
    codes, held = model.bins.of(x), np.arange(400) % 3 == 2
    z = np.zeros(400)
    for k, tree in enumerate(model.trees[0]):
        z += 0.3 * tree["value"][B.routed(tree, codes, model.bins.sizes - 1)]
        assert np.isclose(losses[k], (np.logaddexp(0, z) - y * z)[held].mean())


def test_softmax_finds_planted_classes_on_held_out_rows(spark):
    x, _ = _rows(600, seed=9, gaps=0.05)
    y = np.where(np.nan_to_num(x[:, 0]) > 0.4, 2.0, np.where(np.nan_to_num(x[:, 1]) > 0, 1.0, 0.0))
    df = _frame(spark, x, y)
    model = L.gbt(rounds=12, depth=3, step=0.3, classes=3).fit(df.filter("fold > 0"))
    rows = model.transform(df.filter("fold = 0")).collect()
    assert np.mean([r.label == r.prediction for r in rows]) > 0.9
    assert all(np.isclose(sum(r.probability), 1) and r.prediction == np.argmax(r.probability) for r in rows)


def test_ten_classes_of_embeddings(spark):
    """The labels of ``embeddings`` are drawn at random: scores are probabilities, and held-out rows are near chance."""
    from riskkit.plans import QUERIES
    rows = QUERIES["fit_gbt_classes"](spark, "/root/testdata/sf0.001").collect()
    assert {r.label for r in rows} == set(range(10)) and all(0.1 <= r.p <= 1 and 0 <= r.pred < 10 for r in rows)
    assert np.mean([r.label == r.pred for r in rows]) < 0.3


def test_missing_only_and_constant_features_and_no_rows(spark):
    x, y = _rows(60, gaps=0.0)
    x[:, 1], x[:, 2] = np.nan, 4.0
    df = _frame(spark, x, y)
    model = L.gbt(rounds=3, depth=2).fit(df)
    assert model.ensemble.bins.edges[1] == () and model.ensemble.bins.edges[2] == ()
    p = [r.probability[1] for r in model.transform(df).collect()]
    assert len(p) == 60 and 0 < min(p) < max(p) < 1
    empty = L.gbt(rounds=3).fit(df.filter("false"))
    assert empty.ensemble.trees == ((),) and empty.transform(df.filter("false")).count() == 0


def test_a_saved_model_scores_alike(spark, tmp_path):
    x, y = _rows(80)
    df = _frame(spark, x, y)
    model = L.gbt(rounds=4).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = L.BoostedTreesModel.load(str(tmp_path / "m"))
    a, b = ({r.SEQN: r.probability[1] for r in m.transform(df).collect()} for m in (model, again))
    assert a == b


# --- isotonic ----------------------------------------------------------------------------

def _plain_isotonic(x, y):
    order = np.argsort(x, kind="stable")
    xs, inverse = np.unique(x[order], return_inverse=True)
    total, n = np.bincount(inverse, y[order]), np.bincount(inverse)
    fit = [[t, k, [i]] for i, (t, k) in enumerate(zip(total, n))]
    i = 0
    while i + 1 < len(fit):
        if fit[i][0] / fit[i][1] >= fit[i + 1][0] / fit[i + 1][1]:
            fit[i] = [fit[i][0] + fit[i + 1][0], fit[i][1] + fit[i + 1][1], fit[i][2] + fit[i + 1][2]]
            del fit[i + 1]
            i = max(0, i - 1)
        else:
            i += 1
    value = np.empty(len(xs))
    for t, k, at in fit:
        value[at] = t / k
    return xs, value


@pytest.mark.parametrize("kind", ["noisy", "falling", "rising", "ties"])
def test_isotonic_steps_equal_brute_force(spark, kind):
    r = np.random.default_rng(7)
    rows, want = [], {}
    for g in range(3):
        x = np.round(r.random(200), 1 if kind == "ties" else 9)
        y = {"noisy": (r.random(200) < x).astype(float), "falling": 1 - x, "rising": x, "ties": (r.random(200) < x).astype(float)}[kind]
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
        want[g] = _plain_isotonic(x, y)
    points = spark.createDataFrame(rows, "g int, x double, y double").repartition(3)
    steps = iso.isotonic_steps(points, "g", "x", "y", parts=7)
    got = {}
    for s in steps.collect():
        got.setdefault(s.g, []).append((s.lo, s.hi, s.value))
    for g, (xs, value) in want.items():
        blocks = sorted(got[g])
        assert all(a[2] < b[2] and a[1] < b[0] for a, b in zip(blocks, blocks[1:]))
        at = [next(v for lo, hi, v in blocks if lo <= q <= hi) for q in xs]
        assert np.allclose(at, value, atol=1e-12)
    asked = [(g, float(q)) for g in range(3) for q in [-1.0, 2.0, *r.random(40), want[g][0][3]]] + [(9, 0.5), (None, 0.5)]
    out = iso.applied(spark.createDataFrame(asked, "g int, q double").repartition(4), steps, "g", "q", "v", parts=5).collect()
    assert len(out) == len(asked)
    for o in out:
        assert (o.v is None) if o.g not in want else np.isclose(o.v, np.interp(o.q, *want[o.g]), atol=1e-12)


# --- attributions --------------------------------------------------------------------------

def _subset_values(margin, x, background):
    """Shapley values of one row by listing all subsets, each absent feature taken from every background row in turn."""
    from itertools import combinations
    from math import factorial
    n = x.shape[0]

    def worth(s):
        z = background.copy()
        z[:, list(s)] = x[list(s)]
        return margin(z).mean()

    out = np.zeros(n)
    for j in range(n):
        others = [k for k in range(n) if k != j]
        for size in range(n):
            for s in combinations(others, size):
                out[j] += factorial(size) * factorial(n - size - 1) / factorial(n) * (worth((*s, j)) - worth(s))
    return out


def test_tree_attributions_equal_subset_enumeration(spark):
    from riskkit.operators.explain import tree_attributions
    x, y = _rows(120, width=4)
    df = _frame(spark, x, y)
    model = L.gbt(rounds=5, depth=3, step=0.4, subsample=1.0).fit(df).ensemble
    margin = lambda z: model.margin_of_bins(model.bins.of(z))[:, 0]
    got = tree_attributions(model, df.filter("SEQN < 12"), "SEQN", df).collect()
    assert len({r.base for r in got}) == 1 and np.isclose(got[0].base, margin(x).mean())
    for i in range(12):
        phi = {r.feature: r.phi for r in got if r.SEQN == i}
        assert np.allclose([phi[f"f{j}"] for j in range(4)], _subset_values(margin, x[i], x), atol=1e-9)
        assert np.isclose(sum(phi.values()) + got[0].base, margin(x[i:i + 1])[0])
    with pytest.raises(ValueError):
        tree_attributions(model, df, "SEQN", df.filter("false"))


# --- work that many rows and many models have in common ----------------------------------------

def _walked(tree, code, missing):
    """Leaf of one row, by the rules."""
    k = 0
    while tree["feature"][k] >= 0:
        b = code[tree["feature"][k]]
        k = tree["left"][k] if (tree["missing_left"][k] if b == missing[tree["feature"][k]] else b <= tree["bin"][k]) else tree["right"][k]
    return k


@pytest.mark.parametrize("depth", [0, 1, 4, 12])
def test_rows_reach_the_leaf_that_they_are_walked_to(depth):
    x, y = _rows(3000, seed=11)
    bins = _bins(x, 60)
    codes, missing = bins.of(x), bins.sizes - 1
    assert codes.shape == (5, 3000)
    tree = B.grown(codes, 0.5 - y, np.full(3000, 25.0), bins, B.Boosting(), np.ones(5, bool), depth)
    assert (len(tree) > 256) == (depth == 12)  # both ways of routing
    got = B.routed(tree, codes, missing)
    assert [int(k) for k in got] == [_walked(tree, c, missing) for c in codes.T]
    assert len(B.routed(tree, codes[:, :0], missing)) == 0


def test_histograms_are_sums_by_node_and_slot():
    x, y = _rows(500, seed=12)
    bins = _bins(x)
    codes, node = bins.of(x), np.arange(500) % 3
    sums, rows = B.histograms(codes, bins, node, 3, y, None)
    for k in range(3):
        for f, (start, size) in enumerate(zip(bins.starts, bins.sizes)):
            for b in range(size):
                on = (node == k) & (codes[f] == b)
                assert (sums[k, start + b], rows[k, start + b]) == (y[on].sum(), on.sum())


def test_several_models_of_more_rows_than_a_node_take_no_round_of_jobs(spark, monkeypatch):
    x, y = _rows(500, seed=13)
    bins, df = _bins(x), _frame(spark, x, y)
    specs = [B.Boosting(rounds=3, depth=d, step=0.3, held_fold=f) for d in (2, 4) for f in range(3)]
    alone = [B.fit_all(df, [s], fold="fold", bins=bins, in_task=100)[0][0] for s in specs[-2:]]
    monkeypatch.setattr(B._Fit, "round", lambda *a, **k: pytest.fail("a job a level"))
    got, _ = B.fit_all(df, specs, fold="fold", bins=bins, in_task=100)
    codes = bins.of(x)
    for a, b in zip(alone, got[-2:]):
        assert np.allclose(a.margin_of_bins(codes), b.margin_of_bins(codes), atol=1e-9)


def test_masks_tell_which_conditions_of_a_leaf_a_row_meets(spark):
    from riskkit.operators.explain import LeafPaths
    x, y = _rows(200, width=4, seed=14)
    model = L.gbt(rounds=2, depth=3, step=0.4, subsample=1.0).fit(_frame(spark, x, y)).ensemble
    codes, paths = model.bins.of(x), LeafPaths(model)
    masks = paths.masks(codes)
    assert masks.shape == (len(paths.values), 200)
    # a row meets all conditions of the leaf that it reaches, one a tree
    full = np.array([(1 << len(f)) - 1 for f in paths.features])
    reached = np.array(paths.values) @ (masks == full[:, None])
    assert ((masks == full[:, None]).sum(0) == 2).all() and np.allclose(reached, model.margin_of_bins(codes)[:, 0])


def _leaves_of(tree, codes, missing):
    leaf = np.zeros(codes.shape[1], int)
    for r in range(codes.shape[1]):
        while tree["feature"][leaf[r]] >= 0:
            n = tree[leaf[r]]
            b = codes[n["feature"], r]
            leaf[r] = n["left"] if (n["missing_left"] if b == missing[n["feature"]] else b <= n["bin"]) else n["right"]
    return leaf


@pytest.mark.parametrize("nodes", [1, 3, 40])
def test_packs_sum_up_several_features_in_one_scan(nodes, monkeypatch):
    x, y = _rows(9000, width=9, seed=15)
    x[:, 4:] = x[:, 4:] > 0.2
    bins = _bins(x)
    codes, r = bins.of(x), np.random.default_rng(15)
    packs = B.Packs(codes, bins)
    assert sorted(f for m in packs.members for f in m) == list(range(9)) and len(packs.members) <= 3
    rows, columns = np.flatnonzero(r.random(9000) < 0.7), np.array([0, 2, 3, 5, 8])
    node = r.integers(0, nodes, len(rows))
    sub = B.Bins(tuple(bins.edges[c] for c in columns))
    scans = []
    plain = np.bincount
    monkeypatch.setattr(B.np, "bincount", lambda *a, **k: scans.append(1) or plain(*a, **k))
    got = packs.sums(rows, node, nodes, columns, y[rows])[0]
    monkeypatch.undo()
    assert nodes > 1 or len(scans) < len(columns)
    assert np.allclose(got, B.histograms(codes[np.ix_(columns, rows)], sub, node, nodes, y[rows])[0])


@pytest.mark.parametrize(("depth", "least"), [(3, 0.0), (5, 2.0), (9, 0.0)])
def test_rows_that_are_not_drawn_only_follow_the_tree(depth, least):
    x, y = _rows(3000, seed=16)
    bins = _bins(x)
    codes, r = bins.of(x), np.random.default_rng(16)
    drawn = r.random(3000) < 0.8
    g, h = 0.5 - y, np.full(3000, 25.0)
    spec = B.Boosting(depth=depth, min_gain=least)
    nodes, at = B._grow(B.Packs(codes, bins), g * drawn, h * drawn, spec, np.ones(5, bool), depth, drawn)
    want = B.grown(codes[:, drawn], g[drawn], h[drawn], bins, spec, np.ones(5, bool), depth)
    tree = B.pruned(nodes, least)
    assert len(tree) == len(want) and all(np.array_equal(tree[c], want[c]) for c in ("feature", "bin", "missing_left", "left", "right"))
    assert np.allclose(tree["value"], want["value"], atol=1e-9)
    assert np.array_equal(B.pruned_values(nodes, least)[at], tree["value"][_leaves_of(tree, codes, bins.sizes - 1)])


def test_equal_cuts_of_a_node_go_to_the_first_feature_and_bin():
    # sums of thirds in another order differ in their last bits; feature 1 repeats feature 0, and bins 3 to 5 are empty in the right half
    r = np.random.default_rng(17)
    a = np.where(r.random(900) < 0.5, r.integers(0, 3, 900), r.integers(6, 9, 900)).astype(float)
    x = np.stack([a, a], axis=1)
    bins = B.Bins((tuple(np.arange(8.0)),) * 2)
    g = np.where(a > 4, 2 / 3, -2 / 3) + (a % 3) / 3 + r.normal(size=900) / 30
    tree = B.grown(bins.of(x), g, np.full(900, 1 / 7), bins, B.Boosting(depth=4), np.ones(2, bool), 4)
    inner = tree[tree["feature"] >= 0]
    assert len(inner) > 2 and (inner["feature"] == 0).all() and tree["bin"][0] == 2
    assert not set(inner["bin"].tolist()) & {3, 4, 5}


def test_folds_are_fitted_side_by_side_in_their_order(spark):
    x, y = _rows(300, seed=18, gaps=0.0)
    df = _frame(spark, x, y).cache()
    frames = [df.filter(F.col("fold") != i) for i in range(3)]
    for mine, frame in zip(L.fit_each(L.logistic(), frames), frames, strict=True):
        assert np.allclose(mine.coefficients.toArray(), L.logistic().fit(frame).coefficients.toArray(), atol=1e-9)
    df.unpersist()

"""The distributed primitives against brute force on small skewed fixtures."""

import random

import numpy as np
from pyspark.sql import functions as F

from riskkit.operators import combine as J
from riskkit.operators import metrics as E
from riskkit.operators import profile as A
from riskkit.operators import rank as W


def _skewed(spark, n=3000, seed=1):
    rng = random.Random(seed)
    # one group holds about a third of the rows; many tied values
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", float(rng.randint(0, 40))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, v double"), rows


def test_ordered_positions_matches_sort(spark):
    df, rows = _skewed(spark)
    out = W.ordered_positions(df, ["v", "id"], by=["g"], pos_col="pos", count_col="n").collect()
    expect = {}
    for g in {r[1] for r in rows}:
        grp = sorted([r for r in rows if r[1] == g], key=lambda r: (r[2], r[0]))
        for i, r in enumerate(grp):
            expect[r[0]] = (i + 1, len(grp))
    assert {r.id: (r.pos, r.n) for r in out} == expect


def test_running_totals_matches_cumsum(spark):
    df, rows = _skewed(spark)
    g = df.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    out = {r.v: r.c_cum for r in W.running_totals(g, [F.col("v").desc()], ["c"]).collect()}
    vals = sorted({r[2] for r in rows}, reverse=True)
    acc, expect = 0, {}
    for v in vals:
        acc += sum(1 for r in rows if r[2] == v)
        expect[v] = acc
    assert out == expect


def test_quintile_bins_of_twelve(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(12)] + [(99, None)], "id long, v double")
    bins = [r.bin for r in W.quantile_bins(df, "v", ["id"]).orderBy("id").collect()]
    sizes = [bins[:12].count(b) for b in range(5)]
    assert sizes == [3, 2, 2, 2, 3] and bins[12] is None


def test_equal_width_constant_column_middle_bin(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id long, v double")
    assert [r.bin for r in W.equal_width_bins(df, "v").orderBy("id").collect()] == [2, 2, None]


def test_top_k_per_group_skewed(spark):
    df, rows = _skewed(spark)
    out = W.top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 4).collect()
    got = {(r.g, r.rn): r.id for r in out}
    for g in {r[1] for r in rows}:
        grp = sorted([r for r in rows if r[1] == g], key=lambda r: (-r[2], r[0]))[:4]
        for i, r in enumerate(grp):
            assert got[(g, i + 1)] == r[0]


import pytest


def test_exact_quantiles_match_numpy(spark):
    df, rows = _skewed(spark)
    q = A.exact_quantiles(df, ["v", "id"], [0.0, 0.25, 0.5, 0.9, 1.0], ["a", "b", "c", "d", "e"]).collect()
    got = {r.column_name: [r.a, r.b, r.c, r.d, r.e] for r in q}
    for c, idx in (("v", 2), ("id", 0)):
        arr = np.array([float(r[idx]) for r in rows])
        assert np.allclose(got[c], np.quantile(arr, [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_dedupe_keeps_first_and_null_key_group(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 5, "x"), (None, 3, "y")],
                               "k long, o long, v string")
    got = sorted(J.dedupe_keep_first(df, ["k"], ["o"]).collect(), key=lambda r: (r.k is None, r.k))
    assert [tuple(r) for r in got] == [(1, 1, "a"), (None, 3, "y")]


def test_merge_unique_components_union_group(spark):
    a = spark.createDataFrame([(1, 10.0, 1.0), (2, 20.0, 2.0)], "SEQN long, x double, s double")
    b = spark.createDataFrame([(2, "p", 9.0), (3, "q", 8.0)], "SEQN long, y string, s double")
    m = {r.SEQN: r for r in J.merge_unique_components({"A": a, "B": b}, "SEQN").collect()}
    assert set(m) == {1, 2, 3}
    assert (m[2].x, m[2].y, m[2].s_A, m[2].s_B) == (20.0, "p", 2.0, 9.0)
    assert m[3].x is None and m[1].y is None


def test_auc_ap_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), rng.randint(0, 9) / 10) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    auc = E.roc_auc(df).first()["auc"]
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc - brute) < 1e-6
    ap = E.average_precision(df).first()["ap"]
    total_pos, ap_b = len(pos), 0.0
    for t in sorted({s for *_, s in rows}, reverse=True):
        tp = sum(1 for _, y, s in rows if s >= t and y == 1)
        fp = sum(1 for _, y, s in rows if s >= t and y == 0)
        at = sum(1 for _, y, s in rows if s == t and y == 1)
        ap_b += at / total_pos * tp / (tp + fp)
    assert abs(ap - ap_b) < 1e-6


def test_confusion_report_published_counts(spark):
    # TN 1390, FP 570, FN 40, TP 297
    rows = [(0, 0)] * 1390 + [(0, 1)] * 570 + [(1, 0)] * 40 + [(1, 1)] * 297
    df = spark.createDataFrame(rows, "label int, pred int")
    cm = {(r.actual, r.predicted): r.n for r in E.confusion(df).collect()}
    assert cm == {(0, 0): 1390, (0, 1): 570, (1, 0): 40, (1, 1): 297}
    rep = {r.row_label: r for r in E.classification_report(df).collect()}
    assert abs(rep["accuracy"].f1 - 1687 / 2297) < 1e-6
    assert abs(rep["1"].precision - 297 / 867) < 1e-6 and abs(rep["1"].recall - 297 / 337) < 1e-6
    assert rep["0"].support == 1960 and rep["1"].support == 337
    assert round(rep["macro avg"].f1, 2) == 0.66 and round(rep["weighted avg"].recall, 2) == 0.73


def test_null_keys_quarantined_in_merge_and_fanout(spark):
    a = spark.createDataFrame([(1, 1.0), (None, 2.0), (None, 3.0)], "SEQN long, x double")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "SEQN long, y string")
    m = J.merge_unique_components({"A": a, "B": b}, "SEQN").collect()
    assert len(m) == 4  # key 1 merged; three null-key rows kept apart
    rx = spark.createDataFrame([(1, 10), (1, 11), (None, 12)], "k long, line int")
    f = J.join_fanout(a, rx, "SEQN", "k").collect()
    assert len(f) == 2 + 2 + 1  # two lines for key 1, two null-key base rows, one null-key line


def test_read_component_both_layouts(spark, tmp_path):
    from riskkit.sources import io
    df = spark.createDataFrame([(1, 1.0, "2011_2012"), (2, 2.0, "2013_2014")], "SEQN long, x double, cycle string")
    survey = str(tmp_path / "survey")
    for c in ("2011_2012", "2013_2014"):
        df.filter(df.cycle == c).drop("cycle").write.parquet(f"{survey}/cycle={c}/DEMO_G.parquet")
    got = io.read_component(spark, survey, "demo")
    assert sorted((r.SEQN, r.cycle) for r in got.collect()) == [(1, "2011_2012"), (2, "2013_2014")]
    part = str(tmp_path / "part")
    io.write_components(df, part, {"DEMO": ["x"]}, "SEQN")
    got = io.read_component(spark, part, "DEMO")
    assert sorted((r.SEQN, r.cycle) for r in got.collect()) == [(1, "2011_2012"), (2, "2013_2014")]
    assert io.read_component(spark, part, "LAB") is None


def test_quantile_binner_fitted_edges(spark):
    from riskkit.operators.prep import QuantileBinner
    train = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    model = QuantileBinner(inputCols=["x"], q=5).fit(train)
    edges = model.get_state()["x"]
    assert np.allclose(edges, np.quantile(np.arange(1, 11), [0.2, 0.4, 0.6, 0.8]))
    new = spark.createDataFrame([(0.0,), (2.8,), (2.9,), (100.0,), (None,)], "x double")
    assert [r.x_bin for r in model.transform(new).collect()] == [0, 0, 1, 4, None]


def test_write_with_summary(spark, tmp_path):
    from riskkit.sources import io
    df = spark.createDataFrame([(1, None), (2, 3.0)], "k long, v double")
    summary = io.write_with_summary(df, str(tmp_path / "t"), counted=["v"])
    assert summary == {"rows": 2, "non_null_v": 1, "cols": 2}


def test_components_of_any_case_format_and_columns(spark, tmp_path):
    from riskkit.sources import io
    root = tmp_path / "survey"
    for c in ("2011_2012", "2013_2014", "2015_2016"):
        (root / f"cycle={c}").mkdir(parents=True)
    spark.createDataFrame([(1, 1.0)], "SEQN long, x double").toPandas().to_parquet(root / "cycle=2011_2012" / "demo_g.parquet")
    spark.createDataFrame([(2, 2.0, "n")], "SEQN long, x double, extra string").toPandas().to_parquet(root / "cycle=2013_2014" / "DEMO_H.PARQUET")
    (root / "cycle=2015_2016" / "Demo.csv").write_text("SEQN,x,late\n3,3.5,7\n")
    spark.createDataFrame([(1, 9.0)], "SEQN long, glu double").toPandas().to_parquet(root / "cycle=2011_2012" / "GLU_G.parquet")
    spark.createDataFrame([(1, 8.0)], "SEQN long, tol double").toPandas().to_parquet(root / "cycle=2011_2012" / "GLUTOL_G.parquet")
    demo = io.read_component(spark, str(root), "DEMO")
    assert sorted(demo.columns) == ["SEQN", "cycle", "extra", "late", "x"]
    got = sorted((str(r.SEQN), float(r.x), r.extra, r.late, r.cycle) for r in demo.collect())
    assert got == [("1", 1.0, None, None, "2011_2012"), ("2", 2.0, "n", None, "2013_2014"), ("3", 3.5, None, "7", "2015_2016")]
    assert io.read_component(spark, str(root), "glu").columns == ["SEQN", "glu", "cycle"]
    assert io.read_component(spark, str(root), "HDL") is None
    (root / "cycle=2011_2012" / "BMX_G.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|file"):
        io.read_component(spark, str(root), "BMX").collect()


def test_repeated_keys_are_refused_or_joined(spark):
    a = spark.createDataFrame([(1, None, 5.0), (1, 3.0, 1.0), (2, 1.0, 1.0)], "SEQN long, A double, B double")
    b = spark.createDataFrame([(1, 7.0), (3, 8.0), (None, 9.0)], "SEQN long, C double")
    with pytest.raises(Exception, match="several rows"):
        J.merge_unique_components({"A": a, "B": b}, "SEQN").collect()
    rows = sorted(map(str, J.merge_components({"A": a, "B": b}, "SEQN").collect()))
    want = [(1, None, 5.0, 7.0), (1, 3.0, 1.0, 7.0), (2, 1.0, 1.0, None), (3, None, None, 8.0), (None, None, None, 9.0)]
    assert rows == sorted(f"Row(SEQN={k}, A={x}, B={y}, C={z})" for k, x, y, z in want)


def test_null_safe_merge_matches_missing_keys(spark):
    a = spark.createDataFrame([(1, 1.0), (None, 2.0)], "SEQN long, A double")
    b = spark.createDataFrame([(None, 7.0), (1, 8.0)], "SEQN long, B double")
    rows = {(r.SEQN, r.A, r.B) for r in J.merge_components({"A": a, "B": b}, "SEQN", null_safe=True).collect()}
    assert rows == {(1, 1.0, 8.0), (None, 2.0, 7.0)}
    carried = J.merge_components({"A": a.withColumn("c", F.lit("x")), "B": b.unionAll(b).withColumn("c", F.lit("y"))}, "SEQN", ["c"])
    assert carried.count() == 6 and carried.columns == ["SEQN", "c", "A", "B"]


def test_feature_set_is_built_without_a_job(spark, sf):
    """Building D5 reads no rows: the action count of a fresh job group stays zero."""
    from riskkit.fixtures import survey_view
    from riskkit.operators.survey import features_a
    df = survey_view(spark, sf)  # reads the schema
    spark.sparkContext.setJobGroup("build-only", "features_a")
    features_a(df)
    ran = spark.sparkContext.statusTracker().getJobIdsForGroup("build-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(ran) == []


def test_encoder_has_no_level_limit(spark):
    from riskkit.operators.prep import OrdinalEncoder
    df = spark.range(3000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("c"), (F.col("id") % 7).alias("n"))
    model = OrdinalEncoder(inputCols=["c", "n"]).fit(df)
    new = spark.createDataFrame([("v00000", 6), ("v02999", 0), ("zzz", 9), (None, None)], "c string, n long")
    assert sorted(((r.c, r.n) for r in model.transform(new).collect()), key=str) == sorted([(0, 6), (2999, 0), (-1, -1), (None, None)], key=str)

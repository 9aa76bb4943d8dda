"""Plan shape: no Python UDFs in oracle queries, pushdown/pruning, no single-partition rank."""

import pytest

import __spark_entry__ as E

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["features_a", "features_b", "advice_list", "prevalence_by_age",
                                  "describe_all", "roc_auc", "dedupe_keep_first", "signed_top_k",
                                  "impute_median", "one_hot", "shapley_linear"])
def test_no_python_udf(spark, sf, name):
    plan = _plan(E.queries()[name](spark, sf))
    assert not any(n in plan for n in PY_NODES), plan


def test_projected_scan_prunes_and_pushes(spark, sf):
    df = E.queries()["projected_scan"](spark, sf)
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(CYCLE" in plan
    assert "ReadSchema: struct<SEQN:bigint,LBXGH:double>" in plan


def test_rank_uses_range_partitioning(spark, sf):
    # the ranked frame is checkpointed; its lineage used a range exchange, and the
    # final plan has no window over all rows
    df = E.queries()["rank_first"](spark, sf)
    plan = _plan(df)
    assert "Window [row_number()" not in plan


def test_dedupe_is_partial_aggregate(spark, sf):
    plan = _plan(E.queries()["dedupe_keep_first"](spark, sf))
    assert "partial_min" in plan and "Window" not in plan


def test_component_merge_single_shuffle_for_unique_components(spark, sf):
    from riskkit.plans.joins import GROUPS, component_root
    from riskkit.operators import combine as J
    from riskkit.sources import io
    root = component_root(spark, sf)
    comps = io.load_components(spark, root, list(GROUPS))
    merged = J.merge_unique_components(comps, "SEQN", carry=["cycle"])
    plan = _plan(merged)
    assert plan.count("Exchange hashpartitioning") == 1


def test_running_totals_are_the_one_python_step_of_ranks_and_curves(spark):
    """``roc_auc``, ``describe_all`` and ``impute_median`` add up ranks in one Arrow pass, which their plans hide behind a checkpoint."""
    from pyspark.sql import functions as F
    from riskkit.operators.rank import _local_sums, _ranged
    df = spark.range(100).select(F.col("id").alias("v"), F.lit(1).alias("n"))
    plan = _plan(_local_sums(_ranged(df, ["v"], [], 4), ["n"], []))
    assert plan.count("MapInArrow") == 1 and not any(n in plan for n in PY_NODES if n != "MapInArrow")


def test_running_totals_shuffle_once(spark):
    from pyspark.sql import functions as F
    from riskkit.operators.rank import _local_sums, _ranged
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), F.lit(1).alias("n"))
    plan = _plan(_local_sums(_ranged(df, ["v"], ["g"], 4), ["n"], ["g"]))
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and "Window" not in plan


def test_offsets_are_broadcast_by_their_counted_size(spark):
    from pyspark.sql import functions as F
    from riskkit.operators.rank import ordered_positions
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
        plan = _plan(ordered_positions(df, ["v"], by=["g"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

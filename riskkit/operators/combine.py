"""Joins and set operations.

Component merge has two physical forms.  When every component holds one row
per key, the components are unioned by name and grouped by key: one shuffle
for any number of components (a chain of N full outer joins on a coalesced key
re-shuffles at every step).  A component with many rows per key is joined
afterwards with a null-safe full outer join, which fans out as the reference's
merge does.  Overlapping non-key columns are suffixed with the component name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffix_overlaps(components: Mapping[str, DataFrame], keys: Sequence[str]) -> dict[str, DataFrame]:
    """Rename a non-key column present in several components to ``<col>_<name>``."""
    seen: dict[str, int] = {}
    for df in components.values():
        for c in df.columns:
            if c not in keys:
                seen[c] = seen.get(c, 0) + 1
    out = {}
    for name, df in components.items():
        out[name] = df.select(*[F.col(c).alias(f"{c}_{name}") if seen.get(c, 0) > 1 else F.col(c)
                                for c in df.columns])
    return out


def merge_unique_components(components: Mapping[str, DataFrame], key: str,
                            carry: Sequence[str] = ()) -> DataFrame:
    """J1 (one row per key in every component): union by name, then group by key.

    ``carry`` columns (e.g. the cycle tag) are shared by all components and kept
    as grouping columns.  A component with several rows for one key makes the
    query fail (its columns would be mixed from different rows); see
    ``merge_components``.  Rows with a NULL key pass through unmerged (one output
    row each) instead of all meeting in one group/task.
    """
    keys = [key, *carry]
    named = suffix_overlaps(components, keys)
    frames = [f.withColumn("_component", F.lit(name)) for name, f in named.items()]
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    value_cols = []
    for f in named.values():
        value_cols += [c for c in f.columns if c not in keys and c not in value_cols]
    counts = {name: f"_n{i}" for i, name in enumerate(named)}
    grouped = merged.filter(F.col(key).isNotNull()).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in value_cols],
        *[F.count_if(F.col("_component") == name).alias(n) for name, n in counts.items()])
    checked = F.lit(True)
    for name, n in counts.items():
        several = F.raise_error(F.lit(f"component {name} has several rows for one {key}")).cast("boolean")
        checked = F.when(F.col(n) > 1, several).otherwise(checked)
    loose = merged.filter(F.col(key).isNull()).select(*keys, *value_cols)
    return grouped.filter(checked).select(*keys, *value_cols).unionByName(loose)


def merge_components(components: Mapping[str, DataFrame], key: str, carry: Sequence[str] = (),
                     null_safe: bool = False) -> DataFrame:
    """J1 for any components: those with one row per key in one shuffle, the others joined after.

    One aggregate over the keys finds the components that hold a key more than
    once.  ``null_safe``: rows with a NULL key match each other, as in a merge
    that treats missing keys as equal; else they stay unmatched.
    """
    keys = [key, *carry]
    named = suffix_overlaps(components, keys)
    tagged = union_by_name([f.select(*keys).withColumn("_component", F.lit(n)) for n, f in named.items()])
    several = {r[0] for r in tagged.filter(F.lit(null_safe) | F.col(key).isNotNull()).groupBy("_component", *keys).count()
               .filter("count > 1").select("_component").distinct().collect()}
    if null_safe:
        several |= {r[0] for r in tagged.filter(F.col(key).isNull()).select("_component").distinct().collect()}
    single = {n: f for n, f in named.items() if n not in several}
    rest = [f for n, f in named.items() if n in several]
    out = merge_unique_components(single, key, carry) if single else rest.pop(0)
    for f in rest:
        out = join_fanout(out, f, key, carry=carry, null_safe=null_safe)
    order = [c for f in named.values() for c in f.columns if c not in keys]
    return out.select(*keys, *order)


def join_fanout(base: DataFrame, other: DataFrame, key: str, other_key: str | None = None,
                how: str = "full", carry: Sequence[str] = (), null_safe: bool = False) -> DataFrame:
    """J1 (one-to-many component): outer equi-join on the key (and ``carry``), keys coalesced.

    A full outer join cannot have a skewed partition split by AQE, so it is
    computed as inner join + rows of each side whose key is absent from the
    other.  The inner join is skew-splittable; each anti join probes the
    other side's *distinct* keys, reduced by partial aggregation before the
    shuffle, so a key holding a third of the rows never lands whole in one task.
    NULL keys are quarantined rather than matched to each other (the null-key
    rows of the kept side(s) are appended unmatched), unless ``null_safe``.
    """
    ok = other_key or key
    keys = [key, *carry]
    theirs = {ok: "_r0", **{c: f"_r{i + 1}" for i, c in enumerate(carry)}}
    o = other.select(*[F.col(c).alias(theirs.get(c, c)) for c in other.columns])
    right_keys = [theirs[ok], *[theirs[c] for c in carry]]
    value_cols = [c for c in o.columns if c not in right_keys]
    present = F.lit(True) if null_safe else F.col(key).isNotNull()
    b_ok, o_ok = base.filter(present), o.filter(F.lit(True) if null_safe else F.col("_r0").isNotNull())

    def same(left: DataFrame, lk: Sequence[str], right: DataFrame, rk: Sequence[str]):
        cond = F.lit(True)
        for x, y in zip(lk, rk, strict=True):
            cond = cond & (left[x].eqNullSafe(right[y]) if null_safe or x != lk[0] else left[x] == right[y])
        return cond

    inner = b_ok.join(o_ok, same(b_ok, keys, o_ok, right_keys), "inner")
    out = inner.select(*[b_ok[c] for c in base.columns], *[o_ok[c] for c in value_cols])
    if how in ("full", "outer", "full_outer", "left", "left_outer"):
        o_keys = o_ok.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(right_keys)]).distinct()
        left_only = b_ok.join(o_keys, same(b_ok, keys, o_keys, o_keys.columns), "left_anti")
        out = out.unionByName(left_only, allowMissingColumns=True)
        if not null_safe:
            out = out.unionByName(base.filter(F.col(key).isNull()), allowMissingColumns=True)
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        b_keys = b_ok.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).distinct()
        right_rows = o_ok.join(b_keys, same(o_ok, right_keys, b_keys, b_keys.columns), "left_anti")
        if not null_safe:
            right_rows = right_rows.unionByName(o.filter(F.col("_r0").isNull()))
        named = right_rows.select(*[F.col(r).alias(k) for r, k in zip(right_keys, keys, strict=True)], *value_cols)
        out = out.unionByName(named, allowMissingColumns=True)
    return out.select(key, *[c for c in base.columns if c != key], *value_cols)


def left_join_labels(features: DataFrame, labels: DataFrame, key: str = "SEQN",
                     check_unique: bool = False) -> DataFrame:
    """Left join a label table by key.

    The strategy is left to the optimizer: AQE broadcasts the label side only
    when its measured size is under the broadcast threshold, else sort-merge.
    ``check_unique`` runs one aggregate to assert the label key is unique.
    """
    if check_unique:
        dup = labels.groupBy(key).count().filter("count > 1").limit(1).count()
        if dup:
            raise ValueError(f"label key {key} is not unique")
    return features.join(labels, on=key, how="left")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def bind_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Side-by-side columns of two frames over the same rows, matched by key."""
    return left.join(right, on=key, how="inner")


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order`` (ascending, nulls first).

    Computed as ``min(struct(order..., rest...))`` per key: a sort aggregate on
    either side of one shuffle, so a key holding a third of the rows is reduced
    inside each map task instead of sorted in one window partition.
    Null keys form one group.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*[F.col(c) for c in (*order, *rest)])).alias("_first")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*[F.col(k) for k in keys],
                      *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)

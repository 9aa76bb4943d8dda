"""Looking up a value by a key that one group may hold a third of all rows of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 1024


def look_up(rows: DataFrame, key: Sequence[str], values: DataFrame, salts: int = SALTS) -> DataFrame:
    """``rows`` left-joined with ``values`` (one row per ``key``); a crowded key is spread over ``salts`` tasks.

    Rows are salted by where they lie in their files, so rows that are alike in
    every column part too: ``rows`` must be a written table.  Each (key, salt)
    that occurs gets its own copy of the value; a key has at most ``salts``
    such pairs, which meet in one task.  A null key finds nothing.
    """
    keys = list(key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    held = salted.select(*keys, "_salt").dropna(subset=keys).distinct().join(values, keys)
    return salted.join(held, [*keys, "_salt"], "left").drop("_salt")

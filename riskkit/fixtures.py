"""Survey-shaped view ``SR`` derived from the ``orders`` table.

The driver tables carry no clinical columns, so tests and registered queries
derive them from ``orders`` by integer arithmetic.  The same expressions run
in Spark (``selectExpr``) and, joined into one statement, in DuckDB; both give
identical rows.  The view has nulls, a zero height, zero pressure readings,
age 0, padded text and skip codes on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Base integers taken from each order.
_BASE = [
    "o_orderkey AS k",
    "o_custkey AS c",
    "year(o_orderdate) AS y",
    "CAST(floor(o_totalprice) AS BIGINT) AS p",
]

# Survey columns over the base integers (name -> SQL expression).
SR_COLUMNS: list[tuple[str, str]] = [
    ("SEQN", "k"),
    ("CYCLE", "CASE WHEN y <= 1996 THEN '2011_2012' WHEN y <= 1998 THEN '2013_2014' "
              "WHEN y <= 2000 THEN '2015_2016' ELSE '2017_2018' END"),
    ("RIDAGEYR", "CAST(c % 86 AS DOUBLE)"),
    ("RIAGENDR", "CAST(1 + k % 2 AS DOUBLE)"),
    ("RIDRETH1", "CAST(1 + k % 5 AS DOUBLE)"),
    ("BMXBMI", "CASE WHEN k % 11 = 0 THEN NULL ELSE 15 + CAST(p % 300 AS DOUBLE) / 10 END"),
    ("BMXWAIST", "CASE WHEN k % 13 = 0 THEN NULL ELSE 60 + CAST(p % 70 AS DOUBLE) END"),
    ("BMXHT", "CASE WHEN k % 17 = 0 THEN 0 ELSE 145 + CAST(k % 50 AS DOUBLE) END"),
    ("BPXSY1", "CASE WHEN k % 6 = 0 THEN NULL ELSE 95 + CAST(p % 75 AS DOUBLE) END"),
    ("BPXSY2", "CASE WHEN k % 4 = 0 THEN NULL ELSE 95 + CAST((p + k) % 75 AS DOUBLE) END"),
    ("BPXDI1", "CASE WHEN k % 6 = 0 THEN NULL ELSE CAST((p % 9) * 12 AS DOUBLE) END"),
    ("BPXDI2", "CASE WHEN k % 4 = 0 THEN NULL ELSE 55 + CAST((p + k) % 45 AS DOUBLE) END"),
    ("LBXGLU", "CASE WHEN k % 3 = 0 THEN NULL ELSE 70 + CAST((p * 7) % 90 AS DOUBLE) END"),
    ("LBXGH", "CASE WHEN k % 8 = 0 THEN NULL ELSE 4 + CAST((p * 3) % 35 AS DOUBLE) / 10 END"),
    ("LBXIN", "CASE WHEN k % 3 = 0 THEN NULL ELSE 2 + CAST(p % 40 AS DOUBLE) END"),
    ("LBXTC", "CASE WHEN k % 9 = 0 THEN NULL ELSE 120 + CAST(p % 160 AS DOUBLE) END"),
    ("LBDHDD", "CASE WHEN k % 9 = 0 THEN NULL ELSE 25 + CAST((p + c) % 70 AS DOUBLE) END"),
    ("LBXTR", "CASE WHEN k % 2 = 0 THEN NULL ELSE 40 + CAST((p * 11) % 400 AS DOUBLE) END"),
    ("URXUMA", "CASE WHEN k % 10 = 0 THEN NULL ELSE 1 + CAST(p % 200 AS DOUBLE) END"),
    ("URXUCR", "CASE WHEN k % 10 = 1 THEN NULL ELSE 20 + CAST(p % 250 AS DOUBLE) END"),
    ("DIQ010", "CAST(CASE WHEN k % 12 = 0 THEN 1 WHEN k % 97 = 0 THEN 9 ELSE 2 END AS DOUBLE)"),
    ("SMQ020", "CASE WHEN k % 19 = 0 THEN '7' WHEN k % 5 = 0 THEN ' 1 ' "
               "WHEN k % 7 = 0 THEN '1.0' ELSE '2' END"),
    ("PAQ605", "CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(p % 80 AS DOUBLE) END"),
    ("PAQ620", "CASE WHEN k % 5 = 0 THEN NULL ELSE CAST((p * 13) % 300 AS DOUBLE) END"),
    ("RXDDRUG", "CASE WHEN k % 15 = 0 THEN 'METFORMIN HCL' WHEN k % 16 = 0 THEN 'Insulin Glargine' "
                "WHEN k % 3 = 0 THEN 'LISINOPRIL' ELSE NULL END"),
]

SR_NAMES = [n for n, _ in SR_COLUMNS]

SR_SQL = (
    "WITH b AS (SELECT " + ", ".join(_BASE) + " FROM orders) "
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in SR_COLUMNS) + " FROM b"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (split sizes are the session's ``spark.sql.files`` settings)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def survey_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SR frame: one row per order, survey column names."""
    base = table(spark, sf_dir, "orders").selectExpr(*_BASE)
    return base.selectExpr(*[f"{e} AS {n}" for n, e in SR_COLUMNS])


def with_sr(body: str, ctes: str = "") -> str:
    """Prefix an oracle statement with the SR view (and extra CTEs)."""
    extra = f", {ctes}" if ctes else ""
    return f"WITH SR AS ({SR_SQL}){extra} {body}"

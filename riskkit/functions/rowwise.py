"""Row-wise scalar functions (R1-R20) as native Column expressions.

Null rules follow the missing-value contract: a comparison with a missing
value is false (flags are never NULL), a row mean of nothing is NULL, a row
sum of nothing is 0, a division by zero or by NULL is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColLike = str | Column


def _c(c: ColLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_mean(cols: Sequence[ColLike]) -> Column:
    """Mean of the non-null values in a row; NULL when all are missing."""
    cs = [_c(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cs[1:]), cs[0].isNotNull().cast("int"))
    return F.when(n == 0, F.lit(None).cast("double")).otherwise(total / n)


def row_sum(cols: Sequence[ColLike]) -> Column:
    """R2: sum of the non-null values in a row; 0.0 when all are missing."""
    cs = [F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols]
    return sum(cs[1:], cs[0])


def bins_right_closed(x: ColLike, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Interval bins ``(e_i, e_i+1]``; outside the edges -> NULL."""
    col = _c(x)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (col > F.lit(lo)) & (col <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(None).cast("string"))


def ladder_left_closed(x: ColLike, steps: Sequence[tuple[float, str]], top: str) -> Column:
    """``x < b1 -> l1, x < b2 -> l2, ..., else top``; NULL stays NULL."""
    col = _c(x)
    expr = F.when(col.isNull(), F.lit(None).cast("string"))
    for bound, lab in steps:
        expr = expr.when(col < F.lit(bound), F.lit(lab))
    return expr.otherwise(F.lit(top))


def ladder_upper_inclusive(x: ColLike, steps: Sequence[tuple[float, str, bool]], top: str) -> Column:
    """Ladder where each step is ``x < b`` or ``x <= b`` (flag True)."""
    col = _c(x)
    expr = F.when(col.isNull(), F.lit(None).cast("string"))
    for bound, lab, inclusive in steps:
        cond = col <= F.lit(bound) if inclusive else col < F.lit(bound)
        expr = expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(top))


# Bin sets of the two training feature variants and of the form.
AGE_BINS_A = ([0, 18, 30, 45, 60, 75, 120], ["child", "young", "adult", "mid", "senior", "elder"])
BMI_BINS_A = ([0, 18.5, 25, 30, 35, 100], ["under", "normal", "over", "obese1", "obese2"])
AGE_BINS_B = ([0, 30, 45, 60, 120], ["<30", "30-45", "45-60", ">60"])
BMI_LADDER_B = ([(18.5, "underweight"), (25, "normal"), (30, "overweight")], "obese")
AGE_LADDER_FORM = ([(30, "<30", False), (39, "30-39", True), (49, "40-49", True),
                    (59, "50-59", True)], "60+")
BMI_LADDER_FORM = ([(18.5, "Underweight", False), (25, "Normal", False),
                    (30, "Overweight", False)], "Obese")


def ratio(a: ColLike, b: ColLike) -> Column:
    """A / b with zero or missing divisor -> NULL."""
    return F.try_divide(_c(a), F.nullif(_c(b), F.lit(0)))


def homa_ir(insulin: ColLike, glucose: ColLike, scale: float = 405.0) -> Column:
    """Insulin * glucose / 405 (NULL if either is missing)."""
    return _c(insulin) * _c(glucose) / F.lit(scale)


def any_at_least(pairs: Sequence[tuple[ColLike, float]]) -> Column:
    """Int flag, 1 if any ``col >= threshold``; missing compares false."""
    conds = [F.coalesce(_c(c) >= F.lit(t), F.lit(False)) for c, t in pairs]
    out = conds[0]
    for cnd in conds[1:]:
        out = out | cnd
    return out.cast("int")


def text_flag(x: ColLike, truthy: Sequence[str] = ("1", "1.0")) -> Column:
    """1 if the trimmed text form is one of ``truthy`` else 0."""
    return F.coalesce(F.trim(_c(x).cast("string")).isin(list(truthy)), F.lit(False)).cast("int")


def code_flag(x: ColLike, code: float = 1) -> Column:
    """1 if the numeric code equals ``code`` else 0 (missing -> 0)."""
    return F.coalesce(_c(x) == F.lit(code), F.lit(False)).cast("int")


# Diabetes medication keywords searched in drug-name text.
MEDICATION_KEYWORDS = ["metformin", "glipizide", "glyburide", "pioglitazone", "rosiglitazone",
                       "sitagliptin", "linagliptin", "saxagliptin", "alogliptin",
                       "liraglutide", "semaglutide", "empagliflozin", "dapagliflozin",
                       "insulin", "canagliflozin", "vildagliptin", "repaglinide", "nateglinide"]


def keyword_pattern(words: Sequence[str]) -> str:
    """Alternation of literally-escaped words (regex metacharacters quoted)."""
    special = set("\\.^$|?*+()[]{}")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in w) for w in words)


def keyword_flag(x: ColLike, words: Sequence[str] = MEDICATION_KEYWORDS) -> Column:
    """1 if lower-cased text contains any keyword; NULL text -> 0."""
    return F.coalesce(F.lower(_c(x)).rlike(keyword_pattern(words)), F.lit(False)).cast("int")


def year_start(x: ColLike) -> Column:
    """First 4-digit run as int; no match -> NULL."""
    return F.nullif(F.regexp_extract(_c(x).cast("string"), r"(\d{4})", 1), F.lit("")).try_cast("int")


def product(a: ColLike, b: ColLike) -> Column:
    """Interaction product."""
    return _c(a) * _c(b)


def square(a: ColLike) -> Column:
    """A ** 2."""
    return _c(a) * _c(a)


def clipped_log1p(a: ColLike) -> Column:
    """log1p(max(a, 0)); NULL stays NULL."""
    col = _c(a)
    return F.when(col.isNull(), F.lit(None).cast("double")).otherwise(
        F.log1p(F.greatest(col, F.lit(0.0))))


def coerce_fill(a: ColLike, fill: float = 0.0) -> Column:
    """Lenient numeric cast, then missing -> ``fill``."""
    from .schema import lenient_double
    return F.coalesce(lenient_double(a), F.lit(fill))


def round_to(a: ColLike, digits: int = 4) -> Column:
    """Round half up to ``digits``."""
    return F.round(_c(a), digits)


def thousands(a: ColLike, digits: int = 3) -> Column:
    """Text with thousands separators and fixed decimals."""
    return F.format_number(_c(a), digits)


def fixed(a: ColLike, digits: int = 1) -> Column:
    """Text with fixed decimals, no separators."""
    return F.format_string(f"%.{digits}f", _c(a))

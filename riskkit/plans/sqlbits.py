"""Small SQL fragments shared by oracle statements (mirror the Column builders)."""

from __future__ import annotations

from ..functions.missing import SKIP_TEXT_CODES
from ..functions.rowwise import MEDICATION_KEYWORDS, keyword_pattern


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def ratio(a: str, b: str) -> str:
    return f"({a}) / NULLIF({b}, 0)"


def row_mean(cols: list[str]) -> str:
    n = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols)
    s = " + ".join(f"coalesce({c}, 0)" for c in cols)
    return f"CASE WHEN {n} = 0 THEN NULL ELSE ({s}) / ({n}) END"


def row_sum(cols: list[str]) -> str:
    return "(" + " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in cols) + ")"


def lenient(c: str) -> str:
    v = f"TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE)"
    return f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END)"


def text_flag(c: str) -> str:
    return flag(f"trim(CAST({c} AS VARCHAR)) IN ('1', '1.0')")


def keyword(c: str) -> str:
    return flag(f"regexp_matches(lower({c}), '{keyword_pattern(MEDICATION_KEYWORDS)}')")


def bins_right_closed(x: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {parts} ELSE NULL END"


def ladder(x: str, steps, top: str) -> str:
    parts = " ".join(f"WHEN {x} < {b} THEN '{lab}'" for b, lab in steps)
    return f"CASE WHEN {x} IS NULL THEN NULL {parts} ELSE '{top}' END"


def ladder_incl(x: str, steps, top: str) -> str:
    parts = " ".join(f"WHEN {x} {'<=' if inc else '<'} {b} THEN '{lab}'" for b, lab, inc in steps)
    return f"CASE WHEN {x} IS NULL THEN NULL {parts} ELSE '{top}' END"


def skip_text(c: str) -> str:
    codes = ", ".join(f"'{v}'" for v in SKIP_TEXT_CODES)
    return f"CASE WHEN {c} IN ({codes}) THEN NULL ELSE {c} END"


def year_start(c: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract(CAST({c} AS VARCHAR), '([0-9]{{4}})', 1), '') AS INTEGER)"


def r6(x: str) -> str:
    return f"round({x}, 6)"

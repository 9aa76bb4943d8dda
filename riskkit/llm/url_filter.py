"""URL filters: rules indexed by their rarest literal token.

A rule is a host with a path prefix (``example.net/en/``).  It fits the host
itself and every subdomain when the URL's path starts with the rule's path; of
several that fit, the longest decides.  Each rule is compiled to a regular
expression and filed under one literal token that any fitting URL must hold:
the one that is rarest among the URLs at hand (counted over all of them in
Spark).  A URL's own tokens fetch its candidate rules, and only those run their
regular expressions.

Defined results: a null URL or one without ``://`` has empty host and path; a
URL that no rule fits gets a null rule and the default verdict; an empty rule
list gives that to every URL; repeated rows are judged one by one; other
columns pass through, and columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[^./]+")


@dataclass(frozen=True)
class UrlRule:
    """``text`` is host and path prefix, ``verdict`` what a URL that fits gets."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(str.maketrans(UPPER, LOWER))

    @property
    def path(self) -> str:
        _, slash, path = self.text.partition("/")
        return slash + path

    def pattern(self) -> str:
        return rf"(?:[^/]*\.)?{re.escape(self.host)}(?=/|\Z){re.escape(self.path)}"

    def tokens(self) -> list[str]:
        """Tokens that stand whole in every URL the rule fits: host labels, and path parts closed by ``/`` or ``.``."""
        closed = re.match(r"(?s)(?:.*[./])?", self.path)[0]
        return list(dict.fromkeys([*_TOKEN.findall(self.host), *_TOKEN.findall(closed)]))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.concat_ws("/", host, path), r"[./]+"))


def token_counts(urls: DataFrame, wanted: Sequence[str]) -> dict[str, int]:
    """In how many URLs (columns ``host``, ``path``) each wanted token stands; at most ``len(wanted)`` rows."""
    if not wanted:
        return {}
    found = urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    rows = found.filter(F.col("token").isin(list(wanted))).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def rule_index(rules: Sequence[UrlRule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rarest token -> positions of its rules; rules without a whole token stand under ``""``."""
    index: dict[str, list[int]] = defaultdict(list)
    for i, rule in enumerate(rules):
        tokens = rule.tokens()
        index[min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else ""].append(i)
    return dict(index)


def filter_urls(urls: DataFrame, rules: Sequence[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``urls``.

    The rules come as a list that the caller holds, so their size is known; the
    index goes to the tasks with the function.
    """
    value = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    split = urls.withColumns({"host": url_host(value), "path": url_path(value)})
    wanted = sorted({t for r in rules for t in r.tokens()})
    index = rule_index(rules, token_counts(split.select("host", "path"), wanted))
    patterns = [r.pattern() for r in rules]
    named = [(r.text, r.verdict) for r in rules]
    rank = [(len(r.text), r.text) for r in rules]

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(p, re.S) for p in patterns]
        for hosts, paths in batches:
            out = []
            for host, path in zip(hosts, paths, strict=True):
                text = host + path
                ids = set(index.get("", ()))
                for token in {*_TOKEN.findall(text)}:
                    ids.update(index.get(token, ()))
                fits = [i for i in ids if compiled[i].match(text)]
                out.append(named[max(fits, key=rank.__getitem__)] if fits else (None, default))
            yield pd.DataFrame(out, columns=["rule", "verdict"])

    judged = F.pandas_udf(judge, "rule string, verdict string")
    return (split.withColumn("_judged", judged("host", "path"))
            .withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}).drop("_judged"))


RULES = (UrlRule("net/", "block"), UrlRule("example.net/en/", "allow"),
         UrlRule("example.com/de/", "block"), UrlRule("org/fr/", "allow"))

_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
                       ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rh, rp, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), j AS (
  SELECT s.*, (SELECT max_by(struct_pack(rule := rh || rp, v := v), length(rh || rp)) FROM r
               WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS m
  FROM s
)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict FROM j
"""


@query("op3_url_filter", _SQL)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")

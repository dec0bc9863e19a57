"""URL allow and block rules: a trie over reversed host labels, then path segments.

A rule is (host, path, verdict). It fits a url whose host is the rule's host or a
subdomain of it and whose path starts with the rule's path. Of all rules that fit
the longest wins, counted in characters of host and path; a tie goes to the longer
host, then to block. Where no rule fits, the verdict is `default`.

Defined cases: a url that is null or has no `://` has an empty host and path, which
no rule fits; an empty table gives an empty result; repeated rows are judged each for
itself; other columns of the input pass through, but for those named host, path, rule
or verdict, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.common import LOWER, UPPER, ascii_lower, table

#: More rules than this are joined, not broadcast: some 50 MB as a trie.
MAX_BROADCAST_RULES = 200_000

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _put(root: dict, host: str, path: str, verdict: str) -> None:
    node = root
    for label in reversed(host.split(".")):
        node = node.setdefault("h", {}).setdefault(label, {})
    head, _, tail = path.rpartition("/")
    for segment in head.split("/") if "/" in path else []:
        node = node.setdefault("p", {}).setdefault(segment, {})
    if "/" not in path:
        node = node.setdefault("p0", {})  # a path prefix of less than a segment
    ends = node.setdefault("e", {})
    if ends.get(tail, ("", "", ""))[2] != "block":
        ends[tail] = (host, path, verdict)


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Host labels from the right, then whole path segments; what is left of a path is a prefix of the next segment."""
    root: dict = {}
    for host, path, verdict in rules:
        _put(root, host, path, verdict)
    return root


def _ends(node: dict, rest: str, found: list) -> None:
    for tail, rule in node.get("e", {}).items():
        if rest.startswith(tail):
            found.append(rule)


def lookup(root: dict, host: str, path: str) -> tuple[str, str, str] | None:
    """The rule that wins, or None."""
    found: list[tuple[str, str, str]] = []
    node = root
    for label in reversed(host.split(".")):
        node = node.get("h", {}).get(label)
        if node is None:
            break
        if "p0" in node:
            _ends(node["p0"], path, found)
        inner, at = node, 0
        while (cut := path.find("/", at)) >= 0:
            inner = inner.get("p", {}).get(path[at:cut])
            if inner is None:
                break
            at = cut + 1
            _ends(inner, path[at:], found)
    return max(found, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2])) if found else None


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": host, "path": path})


def url_filter(df: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = "allow", max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule (host and path, null where none fits) and verdict.

    rules: (host, path, verdict) triples, or a DataFrame with these columns. Up to
    max_broadcast rules travel as a trie; more are joined on the host suffix.
    """
    spark = df.sparkSession
    df = split_url(df.drop("host", "path", "rule", "verdict"), url)
    if isinstance(rules, DataFrame):
        listed = [tuple(r) for r in rules.select("host", "path", "verdict").limit(max_broadcast + 1).collect()]
    else:
        listed = list(rules)
        rules = None
    if len(listed) > max_broadcast:
        return _by_join(df, rules if rules is not None else spark.createDataFrame(listed, "host string, path string, verdict string"), default)
    trie = spark.sparkContext.broadcast(build_trie(listed))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        root = trie.value
        got = [lookup(root, h, p) for h, p in zip(host, path)]
        return pd.DataFrame({"rule": [r and r[0] + r[1] for r in got], "verdict": [r[2] if r else default for r in got]})

    out = df.withColumn("_judged", judge("host", "path"))
    return out.withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}).drop("_judged")


def _by_join(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts for any number of rules: each distinct (host, path) meets the rules of its host's suffixes."""
    r = rules.selectExpr("host AS _rh", "path AS _rp", "verdict AS _rv")
    urls = df.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    met = urls.withColumn("_rh", F.explode(suffixes)).join(r, "_rh").where(F.col("path").startswith(F.col("_rp")))
    best = F.max(F.struct(F.length("_rh") + F.length("_rp"), F.length("_rh"), F.col("_rv"), F.concat("_rh", "_rp").alias("rule"))).alias("_b")
    best = met.groupBy("host", "path").agg(best).selectExpr("host AS _h", "path AS _p", "_b.rule AS rule", "_b._rv AS verdict")
    out = df.join(best, (df.host == best._h) & (df.path == best._p), "left").drop("_h", "_p")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op9_url_filter": op9_url_filter}

_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
ORACLE_SQL = {
    "op9_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT page_id, host, path, CASE {_FITS} END AS hit FROM s)
SELECT page_id, host, path, split_part(hit, '|', 1) AS rule, coalesce(split_part(hit, '|', 2), 'allow') AS verdict FROM j"""
}

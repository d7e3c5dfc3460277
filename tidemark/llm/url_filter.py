"""URL filter: a trie over reversed host labels, then path segments, broadcast to the executors.

A rule is ``(host, path, verdict)``. It fits a url when the url's host is the rule's host or one of its
subdomains and the url's path starts with the rule's path (as a string: ``/en/7`` also fits ``/en/77``).
Of the rules that fit, the longest wins: more host labels first, then the longer path. Between an allow and
a block entry for the very same host and path, block wins. A url that no rule fits gets ``default``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The trie is broadcast: more rules than this are refused rather than shipped to every executor.
MAX_RULES = 5_000_000

#: The rules of the registered query.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Host nodes are dicts of labels from the right; each host node may hold a path trie of whole segments.

    The last segment of a rule's path may be incomplete (``/en/7``); it is kept in the node of the complete
    segments before it and compared by prefix, longest first. Only dicts and tuples, so that any worker can
    load it.
    """
    root: dict = {"kids": {}, "paths": None}
    for n, (host, path, verdict) in enumerate(rules):
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        if n >= MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules: too many to broadcast")
        node, host = root, host.lower()
        for label in reversed(host.split(".")):
            node = node["kids"].setdefault(label, {"kids": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = {"kids": {}, "tails": {}, "most": 0}
        *whole, tail = path.split("/")
        at = node["paths"]
        for segment in whole:
            at = at["kids"].setdefault(segment, {"kids": {}, "tails": {}, "most": 0})
        if tail not in at["tails"] or verdict == "block":
            at["tails"][tail] = (host + path, verdict)
            at["most"] = max(at["most"], len(tail))
    return root


def _longest(paths: dict, segments: list[str]) -> tuple[str, str] | None:
    best, at = None, paths
    for segment in segments:
        tails = at["tails"]
        if tails:
            for k in range(min(len(segment), at["most"]), -1, -1):
                if segment[:k] in tails:
                    best = tails[segment[:k]]
                    break
        at = at["kids"].get(segment)
        if at is None:
            break
    return best


def match(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, or None. An empty host fits nothing."""
    if not host:
        return None
    segments, node, best = path.split("/"), root, None
    for label in reversed(host.split(".")):
        node = node["kids"].get(label)
        if node is None:
            break
        if node["paths"] is not None and (found := _longest(node["paths"], segments)):
            best = found
    return best


def split_url(url: str = "url"):
    """Columns (host, path) of a url, both empty where it is null or has no ``://``; only A-Z are lower-cased."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row of ``pages``.

    Null or relative urls have an empty host and path and get the default verdict with a null rule; repeated
    rows are judged each; an empty table gives an empty result; other columns of ``pages`` are not read.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    host, path = split_url(url_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = trie.value
        for b in batches:
            hits = [match(found, h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            rule = pa.array([None if r is None else r[0] for r in hits], pa.string())
            verdict = pa.array([default if r is None else r[1] for r in hits], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), rule, verdict], [id_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, host.alias("host"), path.alias("path")).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def oracle(rules=RULES, default: str = "allow") -> str:
    """The same judgement in DuckDB SQL: every fitting rule, longest host then path first."""
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES {listed}),
m AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC, v DESC) AS k
      FROM s JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT s.page_id, host, path, rule, coalesce(v, '{default}') AS verdict FROM s LEFT JOIN m ON s.page_id = m.page_id AND k = 1"""

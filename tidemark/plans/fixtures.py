"""Input views over the driver's tables in the shapes that the operators take.

Each view is one SQL text for both engines; the few expressions that differ stand in ``DIALECT``. The operators
under test never appear here, only their inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Placeholders by engine.
DIALECT = {
    "spark": {"KICKOFF(": "TIMESTAMP'2025-08-01 13:30:00' + make_dt_interval(7 * ", "JSONK(": "get_json_object(", "JSONEND": ", '$.k')", "HOSTRE": r"'://([^/?#:]+)', 1", "URLRE": r"'^([^#]*)', 1"},
    "duck": {"KICKOFF(": "TIMESTAMP '2025-08-01 13:30:00' + INTERVAL 7 DAY * (", "JSONK(": "json_extract_string(", "JSONEND": ", '$.k')", "HOSTRE": "'://([^/?#:]+)', 1", "URLRE": "'^([^#]*)', 1"},
}

STATS = ("goals", "shots", "sot", "fouls", "corners", "yellow", "red")

VIEWS: dict[str, str] = {
    "fx_team": "SELECT s_suppkey AS team_id, CAST(floor(s_suppkey / 10) AS BIGINT) AS league_id, s_suppkey % 10 AS k, s_name AS team FROM supplier",
    "fx_pair": """SELECT a.league_id, a.team_id AS ta, b.team_id AS tb, a.k AS ka, b.k AS kb,
        CASE WHEN b.k = 9 THEN (2 * a.k) % 9 ELSE (a.k + b.k) % 9 END AS r
        FROM fx_team a JOIN fx_team b ON a.league_id = b.league_id AND a.k < b.k""",
    "fx_leg": """SELECT league_id, r AS rnd, CASE WHEN (ka + kb) % 2 = 0 THEN ta ELSE tb END AS home, CASE WHEN (ka + kb) % 2 = 0 THEN tb ELSE ta END AS away FROM fx_pair
        UNION ALL SELECT league_id, r + 9, CASE WHEN (ka + kb) % 2 = 0 THEN tb ELSE ta END, CASE WHEN (ka + kb) % 2 = 0 THEN ta ELSE tb END FROM fx_pair""",
    "fx_stat": """SELECT l_suppkey AS team_id, l_orderkey % 18 AS rnd,
        sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END) AS goals, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS shots,
        sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS sot, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS fouls,
        sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS corners, sum(CASE WHEN l_discount > 0.085 THEN 1 ELSE 0 END) AS yellow,
        sum(CASE WHEN l_tax > 0.075 AND l_discount < 0.015 THEN 1 ELSE 0 END) AS red FROM lineitem GROUP BY l_suppkey, l_orderkey % 18""",
    "fx_match": "SELECT l.league_id * 1000000 + l.rnd * 10000 + l.home AS match_id, 2025 AS season, l.league_id AS league, l.rnd + 1 AS matchday, KICKOFF(l.rnd) AS kickoff, l.home AS home_team_id, l.away AS away_team_id, "
    + ", ".join(f"CAST(coalesce({s}.{c}, 0) AS BIGINT) AS {side}_{c}" for c in STATS for side, s in (("home", "h"), ("away", "a")))
    + " FROM fx_leg l LEFT JOIN fx_stat h ON h.team_id = l.home AND h.rnd = l.rnd LEFT JOIN fx_stat a ON a.team_id = l.away AND a.rnd = l.rnd",
    "fx_ctx": """SELECT match_id, matchday, league, side, team_id, 2 * (rn - 1) + CASE side WHEN 'home' THEN 0 ELSE 1 END AS ctx FROM (
        SELECT m.*, s.side, CASE s.side WHEN 'home' THEN home_team_id ELSE away_team_id END AS team_id, dense_rank() OVER (ORDER BY match_id) AS rn
        FROM fx_match m CROSS JOIN (SELECT 'home' AS side UNION ALL SELECT 'away') s) x""",
    "fx_task": """SELECT e.event_id AS task_id, e.user_id AS content_id, e.event_type AS source_host, e.ts AS published, c.match_id, c.matchday, c.league, c.side, c.team_id, CAST(JSONK(e.propsJSONEND AS INTEGER) AS k
        FROM events e CROSS JOIN (SELECT count(*) AS n FROM fx_ctx) z JOIN fx_ctx c ON e.event_id % z.n = c.ctx""",
    "fx_note": "SELECT t.*, " + ", ".join(f"CASE WHEN (k + task_id * {i}) % 6 = 5 THEN NULL ELSE CAST((k + task_id * {i}) % 6 - 2 AS INTEGER) END AS i{i}" for i in range(1, 5)) + " FROM fx_task t WHERE task_id % 97 <> 0",
    "fx_note2": "SELECT t.*, " + ", ".join(f"CASE WHEN (k + 1 + task_id * {i}) % 6 = 5 THEN NULL ELSE CAST((k + 1 + task_id * {i}) % 6 - 2 AS INTEGER) END AS i{i}" for i in range(1, 5)) + " FROM fx_task t WHERE task_id % 97 <> 0 AND task_id % 5 = 0",
    "fx_art": """SELECT d.doc_id, d.doc_id % 90 AS day_no, d.lang, d.source, d.text, p.url, lower(regexp_extract(p.url, HOSTRE)) AS host, d.doc_id % 40 AS request_id
        FROM documents d CROSS JOIN (SELECT count(*) AS n FROM pages) z JOIN pages p ON p.page_id = d.doc_id % z.n""",
    "fx_policy": "SELECT DISTINCT host, CASE WHEN length(host) % 3 = 0 THEN 'exclude' ELSE 'include' END AS decision, length(host) * 3 AS article_count FROM fx_art WHERE length(host) % 7 <> 0",
    "fx_raw": """SELECT a.*, CAST(floor(doc_id / 25) AS BIGINT) AS rq, row_number() OVER (PARTITION BY CAST(floor(doc_id / 25) AS BIGINT) ORDER BY doc_id) AS idx, regexp_replace(host, '^www[.]', '') AS nhost, day, doc_id % 59 <> 0 AS has_uri, 'u' || (doc_id % 400) AS uri,
        CASE WHEN doc_id % 29 = 0 THEN 'n/a' ELSE CAST(day AS STRING) END AS date_text, CAST(day AS STRING) || CASE WHEN doc_id % 31 = 0 THEN 'T10:00:00' WHEN doc_id % 37 = 0 THEN 'T23:30:00Z' ELSE 'T10:00:00Z' END AS pub_text,
        CASE WHEN doc_id % 61 <> 0 THEN url END AS url_text, doc_id % 43 <> 0 AS has_source, CASE WHEN doc_id % 41 <> 0 THEN 'T ' || doc_id END AS title, CASE WHEN doc_id % 47 = 0 THEN 'text' WHEN doc_id % 53 = 0 THEN 'number' ELSE 'list' END AS authors_kind
        FROM (SELECT *, CAST(DATE '2025-01-01' + CAST(day_no AS INTEGER) AS DATE) AS day FROM fx_art) a""",
    "fx_rule": "SELECT DISTINCT nhost AS host, CASE WHEN length(nhost) % 3 = 0 THEN 'exclude' ELSE 'include' END AS decision FROM fx_raw WHERE length(nhost) % 7 <> 0",
    "fx_ask": "SELECT DISTINCT 'q' || rq AS request_id, rq, CAST(floor(rq / 2) AS BIGINT) AS match_id, 2025 AS season, 'bl' AS league, CASE WHEN rq % 2 = 0 THEN 'home' ELSE 'away' END AS side, rq AS team_id, 't' || rq AS team, 'team' AS request_type, 'concept' AS query_strategy, '2025-01-11' AS date_start, '2025-03-22' AS date_end, 'en' AS lang FROM fx_raw",
    "fx_ascii": "SELECT doc_id, text, source, lang FROM documents WHERE length(text) = octet_length(CAST(text AS BLOB_)) ",
    "fx_score": "SELECT match_id, matchday, league, mdl, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS actual, "
    + ", ".join(f"CAST((match_id * ({a} + mdl)) % 97 + 1 AS DOUBLE) AS s_{c}" for c, a in (("h", 7), ("d", 11), ("a", 13)))
    + " FROM fx_match CROSS JOIN (SELECT 0 AS mdl UNION ALL SELECT 1) m",
    "fx_pred": "SELECT match_id, matchday, league, mdl, actual, s_h / (s_h + s_d + s_a) AS p_h, s_d / (s_h + s_d + s_a) AS p_d, s_a / (s_h + s_d + s_a) AS p_a, CASE WHEN s_h >= s_d AND s_h >= s_a THEN 'H' WHEN s_d >= s_a THEN 'D' ELSE 'A' END AS predicted FROM fx_score",
}


def _text(name: str, engine: str) -> str:
    out = VIEWS[name]
    for k, v in DIALECT[engine].items():
        out = out.replace(k, v)
    return out.replace("CAST(text AS BLOB_)", "text" if engine == "spark" else "encode(text)")


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\bfx_\w+", text)))


def _order(names: list[str]) -> list[str]:
    done: list[str] = []

    def add(n: str) -> None:
        for m in _needs(VIEWS[n]):
            add(m)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return done


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view (or table) as a DataFrame; nothing is registered in the session's catalog."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _text(name, "spark")
    inputs = {n: view(spark, sf_dir, n) for n in [*_needs(text), *[t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]]}
    for n in inputs:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **inputs)


def duck(sql: str) -> str:
    """A DuckDB query with the views that it names put before it."""
    names = _order(_needs(sql))
    ctes = ",\n".join(f"{n} AS ({_text(n, 'duck')})" for n in names)
    body = sql.strip()
    if not names:
        return body
    return f"WITH {ctes}" + (",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body)

"""Articles from raw responses: occurrences, policy documents, the rejection chain, normalized rows and links.

Responses are JSON of any shape, so they are read as variants: a field counts only if it has the type it should have.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import checks as C
from .news import first_reason

#: The columns of a normalized article and of an article's link to its request.
ARTICLE = ("article_id", "event_registry_uri", "url", "source_host", "source_uri", "source_title", "language", "event_registry_date", "publication_datetime", "title", "body", "authors")
LINK = ("request_id", "article_id", "match_id", "season", "league", "side", "team_id", "team", "request_type", "query_strategy", "date_start", "date_end", "request_article_index", "raw_response_path")
#: What a policy says of hosts, and the only way a rule fits.
DECISIONS = ("include", "exclude")
MATCHES = "exact_host"


def zone(name: str) -> str:
    """A time zone by its IANA name; others, offsets included, are an error."""
    if name not in available_timezones():
        raise ValueError(f"unknown time zone {name!r}")
    return ZoneInfo(name).key


def _kind(v: Column) -> Column:
    """Type of a variant as SQL names it; null for null and for JSON null."""
    kind = F.schema_of_variant(v)
    return F.when(kind != "VOID", kind)


def _text(v: Column, path: str) -> Column:
    """A stripped string that is not empty; null for anything else."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", S.optional_text(F.try_variant_get(v, path, "string")))


def _texts(rows: DataFrame, paths: Mapping[str, str], v: str = "raw") -> DataFrame:
    """``_text`` of several paths as columns. Each step is a projection of its own, so that no field is read again for
    every time that an expression names it; as one expression the chain outgrows what Java's compiler takes."""
    rows = rows.withColumns({c: F.try_variant_get(v, path, "variant") for c, path in paths.items()})
    rows = rows.withColumns({c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")) for c in paths})
    return rows.withColumns({c: S.optional_text(F.col(c)) for c in paths})


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(kind)), F.lit(False))


def occurrences(responses: DataFrame, body: str = "body") -> DataFrame:
    """Responses' articles, one row each: the other columns, ``request_article_index`` (from 1) and variant ``raw``.

    A response must be an object whose ``articles.results`` is an array of objects; ``response_violations`` tells
    which are not, and those give no rows here.
    """
    v = responses.withColumn("_v", F.try_parse_json(body)).drop(body)
    listed = F.try_variant_get("_v", "$.articles.results", "array<variant>")
    kept = [c for c in v.columns if c != "_v"]
    out = v.select(*kept, F.posexplode(listed).alias("_p", "raw")).select(*kept, (F.col("_p") + 1).alias("request_article_index"), "raw")
    return out.filter(F.startswith(F.schema_of_variant("raw"), F.lit("OBJECT")))


def response_violations(responses: DataFrame, key: Sequence[str], body: str = "body") -> DataFrame:
    """Responses that are no objects, have no list of articles, or list something that is no object."""
    v = F.try_parse_json(body)
    results = F.try_variant_get(v, "$.articles.results", "array<variant>")
    objects = F.forall(results, lambda x: F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit(False)))
    return C.holds(responses, "response", _is(v, "$", "OBJECT") & _is(v, "$.articles", "OBJECT") & _is(v, "$.articles.results", "ARRAY") & objects, key)


def source_host(raw: Column) -> Column:
    """Host of an article's homepage: of its own url or, failing that, of its source's; one ``www.`` dropped."""
    return S.host_of(F.coalesce(S.homepage(_text(raw, "$.url")), S.homepage(_text(raw, "$.source.uri"))))


def authors(raw: Column) -> Column:
    """Authors as (uri, name, type, is_agency), in order; null as a whole if the field is no array or if one of them is
    no object or has an ``isAgency`` that is neither a truth value nor null."""
    given = F.try_variant_get(raw, "$.authors", "array<variant>")
    agency = lambda a: F.try_variant_get(a, "$.isAgency", "variant")
    fine = F.forall(given, lambda a: F.coalesce(F.startswith(F.schema_of_variant(a), F.lit("OBJECT")), F.lit(False)) & F.coalesce(_kind(agency(a)) == "BOOLEAN", F.lit(True)))
    one = lambda a: F.struct(_text(a, "$.uri").alias("uri"), _text(a, "$.name").alias("name"), _text(a, "$.type").alias("type"), F.try_variant_get(a, "$.isAgency", "boolean").alias("is_agency"))
    return F.when(_is(raw, "$.authors", "ARRAY") & fine, F.transform(given, one))


def policy_decisions(document: DataFrame, body: str = "body") -> DataFrame:
    """``(host, decision)`` of a policy document ``{schema_version, unknown_hosts, rules: [{host, match, decision}]}``."""
    v = F.try_parse_json(body)
    return document.select(F.explode(F.try_variant_get(v, "$.rules", "array<struct<host:string,match:string,decision:string>>")).alias("r")).select("r.host", "r.decision")


def policy_violations(document: DataFrame, body: str = "body") -> DataFrame:
    """What is wrong with a policy document: version, treatment of unknown hosts, no rules, other matches or decisions,
    hosts that are not normalized, hosts with several rules."""
    v = F.try_parse_json(body)
    rules = F.try_variant_get(v, "$.rules", "array<struct<host:string,match:string,decision:string>>")
    d = document.select(F.try_variant_get(v, "$.schema_version", "int").alias("version"), F.try_variant_get(v, "$.unknown_hosts", "string").alias("unknown"), rules.alias("rules"))
    each = d.select(F.explode("rules").alias("r")).select("r.*")
    normal = F.regexp_replace(F.rtrim(F.lower(F.trim("host")), F.lit(".")), r"^www\.", "")
    whole = C.holds(d, "policy", (F.col("version") == 1) & (F.col("unknown") == "exclude") & (F.size("rules") > 0), [])
    rule = C.holds(each, "policy rule", (F.col("match") == MATCHES) & F.col("decision").isin(*DECISIONS) & (F.col("host") == normal) & (F.col("host") != ""), ["host"])
    return whole.unionByName(rule).unionByName(C.unique(each, ["host"], "policy host"))


def request_violations(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Planned requests with an unknown side or an inverted window, matches without both sides, sides asked twice,
    repeated ids."""
    sides = requests.groupBy("match_id").agg(F.array_sort(F.collect_list("side")).alias("_s"))
    one = C.holds(requests, "request", F.col("side").isin("home", "away") & (F.to_date("date_start") <= F.to_date("date_end")), [key])
    both = C.holds(sides, "request sides", F.col("_s") == F.array(F.lit("away"), F.lit("home")), ["match_id"])
    return one.unionByName(both).unionByName(C.unique(requests, [key], "request id"))


def judge(found: DataFrame, requests: DataFrame, policy: DataFrame, time_zone: str) -> DataFrame:
    """Every occurrence with its request's columns, a normalized article's columns and ``reason``: why it is rejected,
    by the first rule of the chain that holds, or null.

    The policy is a small table and joined as Catalyst sees fit; no occurrence is lost to it.
    """
    raw, tz = F.col("raw"), zone(time_zone)
    o = _texts(found.join(requests, "request_id"), {"_own": "$.url", "_from": "$.source.uri"})
    o = o.withColumns({c: S.homepage(F.col(c)) for c in ("_own", "_from")}).withColumn("_home", F.coalesce("_own", "_from"))
    o = o.withColumn("source_host", S.host_of(F.col("_home"))).drop("_own", "_from", "_home")
    o = o.join(policy.select(F.col("host").alias("source_host"), "decision"), "source_host", "left").withColumn("decision", F.coalesce("decision", F.lit("unknown")))
    o = _texts(o, {
        "event_registry_uri": "$.uri", "url": "$.url", "language": "$.lang", "title": "$.title", "body": "$.body",
        "source_uri": "$.source.uri", "source_title": "$.source.title", "event_registry_date": "$.date", "publication_datetime": "$.dateTimePub",
    })
    o = o.withColumns({"url": S.canonical_url(F.col("url")), "event_registry_date": S.iso_date(F.col("event_registry_date")), "publication_datetime": S.iso_timestamp(F.col("publication_datetime")), "authors": authors(raw)})
    begin, end = F.to_date("date_start"), F.to_date("date_end")
    title = F.schema_of_variant(F.try_variant_get(raw, "$.title", "variant"))
    rules = [
        ("missing_source_host", F.col("source_host").isNull() | (F.col("source_host") == "")),
        ("policy_exclude", F.col("decision") == "exclude"),
        ("policy_unknown_host", F.col("decision") == "unknown"),
        ("missing_language", F.col("language").isNull()),
        ("language_mismatch", F.col("language") != F.col("lang")),
        ("invalid_event_registry_date", F.col("event_registry_date").isNull()),
        ("event_registry_date_outside_request_window", ~F.col("event_registry_date").between(begin, end)),
        ("invalid_publication_datetime", F.col("publication_datetime").isNull()),
        ("publication_datetime_outside_request_window", ~S.local_date(F.col("publication_datetime"), tz).between(begin, end)),
        ("invalid_article_url", F.col("url").isNull()),
        ("missing_article_body", F.col("body").isNull()),
        ("invalid_article_title", ~title.isin("VOID", "STRING")),
        ("invalid_article_source", ~_is(raw, "$.source", "OBJECT")),
        ("invalid_article_authors", F.col("authors").isNull()),
    ]
    return o.withColumn("article_id", S.article_id(F.col("event_registry_uri"), F.col("url"))).withColumn("reason", first_reason(rules))


def articles(judged: DataFrame) -> DataFrame:
    """The accepted articles, each once: of one id's occurrences the first by request and place."""
    return _first(judged, ["article_id"], ARTICLE, F.struct("request_id", "request_article_index"))


def links(judged: DataFrame) -> DataFrame:
    """Which request's occurrence brought an article, the first of a request that lists it more than once."""
    return _first(judged, ["request_id", "article_id"], LINK, F.col("request_article_index"))


def _first(judged: DataFrame, key: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    """Each key's first accepted row. Rejected ones have no place in the order: a filter before the groups would carry the
    whole chain down to the raw rows, every field written out wherever a rule names it."""
    place = F.when(F.col("reason").isNull(), order)
    return judged.groupBy(*key).agg(F.min_by(F.struct(*columns), place).alias("_a")).filter(F.col("_a").isNotNull()).select("_a.*")


def normalized_title(c: Column) -> Column:
    """A title as bodies are normalized; null stays null, and so does one that has nothing left."""
    return F.nullif(S.normalized_body(c), F.lit(""))


def completion_ok(payload: Column) -> Column:
    """Whether a model's reply says that it is done, for no other reason than to stop."""
    v = F.try_parse_json(payload)
    reason = F.try_variant_get(v, "$.done_reason", "string")
    return F.coalesce(F.try_variant_get(v, "$.done", "boolean"), F.lit(False)) & (_kind(F.try_variant_get(v, "$.done_reason", "variant")).isNull() | (reason == "stop"))


def chosen(rows: DataFrame, column: str, value) -> DataFrame:
    """The rows with that value; none at all is an error, raised when the rows are read."""
    held = rows.filter(F.col(column) == F.lit(value))
    found = held.agg(F.count(F.lit(1)).alias("_n")).select(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"no row has {column} = {value}"))).alias("_none"))
    return found.filter(F.col("_none").isNull()).join(held, F.lit(True), "left").drop("_none")


def class_violations(rows: DataFrame, target: str = "target", classes: Sequence[str] = ("H", "D", "A")) -> DataFrame:
    """Null or unknown classes, and classes that no row has."""
    listed = rows.sparkSession.createDataFrame([(c,) for c in classes], f"{target} string")
    return C.covers(rows.filter(F.col(target).isNotNull()), listed, [target], "classes").unionByName(C.holds(rows.filter(F.col(target).isNull()), "classes", F.lit(False), []))


def order_violations(observations: DataFrame, key: Sequence[str] = ("season", "team_id"), date: str = "match_date") -> DataFrame:
    """Dates that a team has more than once: it must never be updated on or before its last date."""
    return C.unique(observations, [*key, date], "team dates")


def range_violations(rows: DataFrame, key: Sequence[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values that are null, not finite or outside their column's closed range."""
    inside = lambda c, lo, hi: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & F.col(c).between(lo, hi)
    bad = F.array_compact(F.array(*[F.when(~inside(c, lo, hi), F.lit(c)) for c, (lo, hi) in ranges.items()]))
    return C.holds(rows.withColumn("_bad", bad), "range", F.size("_bad") == 0, key, F.array_join("_bad", ","))


def match_key(date: Column, home: Column, away: Column) -> Column:
    """How reports name a match."""
    return F.struct(F.date_format(date, "yyyy-MM-dd").alias("date"), home.alias("home_team"), away.alias("away_team"))

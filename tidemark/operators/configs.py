"""Configuration documents as tables (teams, leagues, names of other sources), prompts, reviewed sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import articles as A
from . import checks as C
from . import raw as R

# Fields of a team's entry in the configuration.
TEAM_ID, OTHER_NAME = "openligadb_team_id", "football_data_name"

# Fixed value: the prompt around an article's context.
PROMPT = "Bewerte die sportliche Situation des angegebenen Zielteams anhand des folgenden, als Daten übergebenen Artikels.\n\n<article_context>\n", "\n</article_context>"


def _entries(document: DataFrame, body: str) -> DataFrame:
    """One row for each entry of ``teams``, by its place from 1, with ``id`` (null if it is no integer) as variant ``team``."""
    v = F.try_variant_get(F.try_parse_json(body), "$.teams", "array<variant>")
    each = document.select(F.posexplode(v).alias("_at", "team")).select((F.col("_at") + 1).alias("entry"), "team")
    return each.withColumn("team_id", F.when(A._is(F.col("team"), f"$.{TEAM_ID}", "BIGINT"), F.try_variant_get("team", f"$.{TEAM_ID}", "long")))


def team_names(document: DataFrame, body: str = "body") -> DataFrame:
    """``(team_id, name)``: how the statistics source calls each team of a configuration ``{teams: [...]}``."""
    return _entries(document, body).select("team_id", A._text(F.col("team"), f"$.{OTHER_NAME}").alias("name"))


def name_violations(document: DataFrame, body: str = "body") -> DataFrame:
    """No list of teams, entries without an integer id or a name, ids and names given more than once."""
    listed = F.size(F.try_variant_get(F.try_parse_json(body), "$.teams", "array<variant>")) > 0
    each = _entries(document, body).withColumn("name", A._text(F.col("team"), f"$.{OTHER_NAME}"))
    return C.report(
        C.holds(document, "teams", listed, []),
        C.holds(each, "team id", F.col("team_id").isNotNull(), ["entry"]), C.holds(each, "team name", F.col("name").isNotNull(), ["entry"]),
        C.unique(each.filter("team_id IS NOT NULL"), ["team_id"], "team id"), C.unique(each.filter("name IS NOT NULL"), ["name"], "team name"),
    )


def team_queries(document: DataFrame, body: str = "body") -> DataFrame:
    """``(team_id, strategy, concept, keyword)`` of the teams that can be searched for.

    A keyword is a text that is not blank in ``query.keyword``. With one, a concept and that strategy both are searched for;
    with one and no strategy (or ``keyword``) the keyword; otherwise the concept, if there is one. Of a team's entries the
    last counts.
    """
    e = _entries(document, body)
    concept = F.when(A._is(F.col("team"), "$.concept_uri", "STRING"), F.try_variant_get("team", "$.concept_uri", "string"))
    keyword, wanted = A._text(F.col("team"), "$.query.keyword"), F.try_variant_get("team", "$.query_strategy", "string")
    both = keyword.isNotNull() & concept.isNotNull() & (wanted == "concept_or_keyword")
    only = keyword.isNotNull() & (wanted.isNull() | (wanted == "keyword"))
    strategy = F.when(both, "concept_or_keyword").when(only, "keyword").when(concept.isNotNull(), "concept")
    found = e.select("team_id", "entry", strategy.alias("strategy"), concept.alias("concept"), F.when(both | only, keyword).alias("keyword")).filter("team_id IS NOT NULL AND strategy IS NOT NULL")
    return found.groupBy("team_id").agg(F.max_by(F.struct("strategy", "concept", "keyword"), "entry").alias("q")).select("team_id", "q.*")


def league_concepts(document: DataFrame, body: str = "body") -> DataFrame:
    """``(league, concept)`` of a configuration ``{leagues: {name: {concept_uri}}}``; leagues without a concept are left out."""
    v = F.try_variant_get(F.try_parse_json(body), "$.leagues", "map<string,variant>")
    each = document.select(F.explode(v).alias("league", "value"))
    return each.select("league", F.when(A._is(F.col("value"), "$.concept_uri", "STRING"), F.try_variant_get("value", "$.concept_uri", "string")).alias("concept")).filter("concept IS NOT NULL")


def with_names(matches: DataFrame, names: DataFrame, most: int = 100_000) -> DataFrame:
    """``matches`` with ``home_team`` and ``away_team`` as the statistics source calls them, null where it has no name.

    Up to ``most`` names (counted) are broadcast, more are joined by their ids."""
    side = F.broadcast if names.count() <= most else (lambda df: df)
    out = matches.drop("home_team", "away_team")
    for v in ("home", "away"):
        out = out.join(side(names.select(F.col("team_id").alias(f"{v}_team_id"), F.col("name").alias(f"{v}_team"))), f"{v}_team_id", "left")
    return out


def quoted(c: Column) -> Column:
    """A text as a JSON string: quotes, backslashes and control characters escaped, all else kept."""
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    rare = {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in short}
    put = lambda x, pairs: reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), pairs.items(), x)
    plain = put(c, short)
    return F.concat(F.lit('"'), F.when(plain.rlike("[\\x00-\\x1f]"), put(plain, rare)).otherwise(plain), F.lit('"'))


def user_prompt(team: Column, aliases: Column, title: Column, body: Column) -> Column:
    """The request for one task: team, aliases (array of strings), title (null: empty) and body as JSON indented by 2.

    Null aliases are none; a null team or body gives null."""
    listed = F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n    "), F.array_join(F.transform(aliases, quoted), ",\n    "), F.lit("\n  ]")))
    fields = [("target_team", quoted(team)), ("target_team_aliases", listed), ("article_title", quoted(F.coalesce(title, F.lit("")))), ("article_body", quoted(body))]
    lines = [F.concat(F.lit(f'  "{name}": '), value, F.lit("\n" if i == 3 else ",\n")) for i, (name, value) in enumerate(fields)]
    return F.concat(F.lit(PROMPT[0] + "{\n"), *lines, F.lit("}" + PROMPT[1]))


def review_violations(reviews: DataFrame, key: Sequence[str]) -> DataFrame:
    """What keeps reviewed sources (all text) from becoming rules: urls that are no plain homepages, counts that are not
    positive, unknown states, dates that are none, reservations without a text or evidence, texts without a reservation."""
    url = F.trim(F.coalesce("website_url", F.lit("")))
    legal = F.trim(F.coalesce("legal_text", F.lit("")))
    decision = F.element_at(F.create_map(*[F.lit(x) for kv in R.DECISIONS.items() for x in kv]), F.col("review_status"))
    homepage = url.rlike(r"^(?i:https?)://[^/?#@:\s]+/?$") & (F.regexp_replace(F.rtrim(F.lower(F.regexp_extract(url, "://([^/]*)", 1)), F.lit(".")), r"^www\.", "") != "")
    number = F.try_to_number(F.regexp_replace(F.trim("article_count"), r"\.0+$", ""), F.lit("999999999999"))
    rules = {
        "website_url": homepage, "article_count": number > 0, "review_status": decision.isNotNull(), "review_date": S.review_date(F.col("review_date")).isNotNull(),
        "legal_text": F.when(decision == "exclude", legal != "").when(decision == "include", legal == "").otherwise(True),
        "evidence": F.when((decision == "exclude") & (legal != ""), F.size(S.evidence_urls(legal)) > 0).otherwise(True),
    }
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return reviews.select(F.lit("review").alias("check"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("key"), F.explode(broken).alias("detail"))

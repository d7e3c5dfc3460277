"""Command line: each step reads a season's tables from a layout and writes the next.

``python -m tidemark.cli COMMAND --root DIR --season 2025 [options]``. Steps that talk to services take their
transport from Python (see ``sources.services``) and are not offered here.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import articles as A
from .operators import checks as C
from .operators import configs as G
from .operators import evaluation as E
from .operators import matches as M
from .operators import multinomial as X
from .operators import news as N
from .operators import raw as R
from .operators import reports as P
from .operators import selection
from .sources import files, store
from .sources import workbooks as W

CS = (0.01, 0.1, 1.0, 10.0)
FOLDS = {27: ((12, 13, 17), (17, 18, 22), (22, 23, 27))}  # by the last matchday of the training rows


# The sheet and the columns of a review of sources.
SHEET = "sources"
REVIEW = ("website_url", "article_count", "legal_text", "review_status", "review_date")


class Season:
    """Tables of one season by stage and name."""

    def __init__(self, spark: SparkSession, root: str, season: int):
        self.spark, self.layout, self.season = spark, files.Layout(root, season), season

    def read(self, stage: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.layout.path(stage, name))

    def write(self, df: DataFrame, stage: str, name: str) -> None:
        df.write.mode("overwrite").parquet(self.layout.path(stage, name))

    def document(self, name: str) -> DataFrame | None:
        """A raw JSON document as one row ``body``, None if there is none."""
        path = self.layout.path("raw", name)
        if store.read_bytes(path) is None:
            return None
        return self.spark.read.option("wholetext", True).text(path).select(F.col("value").alias("body"))

    def report(self, df: DataFrame, name: str) -> None:
        df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(self.layout.path("reports", name))


def build_matches(s: Season, a) -> None:
    raw = files.read_json_array(s.spark, s.layout.path("raw", "matches.json"), R.RAW_MATCH)
    out = R.normalize_matches(raw, a.league, s.season, a.timezone)
    C.enforce(C.not_empty(raw), C.unique(raw, ["matchID"]))
    s.write(out, "interim", "matches")


def build_numerical_matches(s: Season, a) -> None:
    """Matches joined one to one with the statistics file on (date, home, away); leftovers are errors.

    With a configuration of teams (``raw/teams.json``) matches take the names of the statistics source first; a team without
    one is an error."""
    m = s.read("interim", "matches").withColumn("date", F.to_date(F.substring("kickoff", 1, 10)))
    if (config := s.document("teams.json")) is not None:
        C.enforce(G.name_violations(config))
        m = G.with_names(m, G.team_names(config))
        C.enforce(C.holds(m, "team name", F.col("home_team").isNotNull() & F.col("away_team").isNotNull(), ["match_id"]))
    raw = files.read_csv(s.spark, s.layout.path("raw", "stats.csv"), ("Date", "HomeTeam", "AwayTeam"))
    names = {"goals": ("FTHG", "FTAG"), "shots": ("HS", "AS"), "sot": ("HST", "AST"), "fouls": ("HF", "AF"), "corners": ("HC", "AC"), "yellow": ("HY", "AY"), "red": ("HR", "AR")}
    stats = raw.select(S.day_first_date(F.col("Date")).alias("date"), F.col("HomeTeam").alias("home_team"), F.col("AwayTeam").alias("away_team"), *[S.whole_number(F.col(c)).alias(f"{side}_{k}") for k, cs in names.items() for side, c in zip(("home", "away"), cs)])
    keys = ["date", "home_team", "away_team"]
    parts = M.reconcile(m.drop("home_goals", "away_goals"), stats, keys)
    C.enforce(C.unique(stats, keys), C.covers(m, stats, keys), C.required(stats, {c: "count" for c in stats.columns[3:]}, keys))
    out = parts["matched"].withColumn("kickoff", F.to_timestamp("kickoff"))
    C.enforce(C.holds(out, "domain", (F.col("home_sot") <= F.col("home_shots")) & (F.col("away_sot") <= F.col("away_shots")), ["match_id"]))
    s.write(out, "interim", "numerical_matches")


def build_numerical_features(s: Season, a) -> None:
    out = M.numerical_features(s.read("interim", "numerical_matches"), a.train_end, a.last)
    C.enforce(C.unique(out, ["match_id"]), C.chronological(out, F.col("dataset_split") == "train", F.col("dataset_split") == "test", "kickoff"))
    s.write(out, "processed", "numerical_features")


def build_news_requests(s: Season, a) -> None:
    m = s.read("interim", "matches").withColumnsRenamed({"window_start": "date_start", "window_end": "date_end"})
    C.enforce(C.holds(m, "window", F.col("date_start").isNotNull(), ["match_id"]))
    config = s.document("teams.json")
    teams, leagues = (s.read("raw", "teams"), s.read("raw", "leagues")) if config is None else (G.team_queries(config), G.league_concepts(config))
    sides = m.select("match_id", "league", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    C.enforce(C.covers(sides, teams, ["team_id"], "team query", both=False), C.covers(sides, leagues, ["league"], "league concept", both=False))
    s.write(R.requests(m, teams, leagues, a.lang), "interim", "requests")


def build_news_source_policy(s: Season, a) -> None:
    """Rules from the reviewed sources: a workbook (``raw/review.xlsx``) or else ``raw/review.csv``."""
    book = s.layout.path("raw", "review.xlsx")
    if store.read_bytes(book) is not None:
        reviews = W.read_workbooks(s.spark, book, list(REVIEW), SHEET)
    else:
        reviews = files.read_csv(s.spark, s.layout.path("raw", "review.csv"), REVIEW)
    C.enforce(C.not_empty(reviews), G.review_violations(reviews, ["website_url"]))
    out = R.policy_rules(reviews.withColumn("article_count", F.regexp_replace("article_count", r"\.0+$", "")))
    C.enforce(C.unique(out, ["host"]), C.required(out, {"host": "text", "decision": "text", "article_count": "positive", "review_date": "present"}, ["website_url"]))
    s.write(out, "processed", "source_policy")


def _responses(s: Season) -> DataFrame:
    """The stored responses, one a file named after its request, with what each is asked for."""
    folder = s.layout.path("raw", "responses")
    files_ = s.spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    name = F.url_decode(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    out = files_.select(name.alias("request_id"), F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("raw_response_path"), F.col("value").alias("body"))
    asked = s.read("interim", "requests")
    C.enforce(A.request_violations(asked), C.covers(asked, out, ["request_id"], "responses"), A.response_violations(out, ["request_id"]))
    return out


def export_news_source_review(s: Season, a) -> None:
    host = A.source_host(F.col("raw"))
    out = A.occurrences(_responses(s)).withColumn("host", host).filter(F.col("host").isNotNull()).groupBy(F.concat(F.lit("https://"), "host").alias("website_url")).agg(F.count(F.lit(1)).alias("article_count"))
    C.enforce(C.not_empty(out))
    s.write(out.orderBy(F.desc("article_count"), "website_url"), "interim", "source_review")
    # one row a host, the greatest first, in the order in which a reviewer works through them: one workbook, written row by row
    sheet = s.read("interim", "source_review").select("website_url", "article_count", *[F.lit(None).cast("string").alias(c) for c in REVIEW[2:]])
    W.write_workbooks(sheet.repartitionByRange(1, F.desc("article_count"), "website_url").sortWithinPartitions(F.desc("article_count"), "website_url"), s.layout.path("interim", "source_review_workbook"), SHEET, overwrite=a.overwrite)


def build_news_articles(s: Season, a) -> None:
    """Occurrences of the stored responses judged by the whole chain; accepted articles, their links and the report."""
    policy = s.read("processed", "source_policy").select("host", "decision")
    asked = s.read("interim", "requests").withColumn("lang", F.lit(a.lang))
    judged = A.judge(A.occurrences(_responses(s)), asked, policy, a.timezone).persist()
    try:
        s.report(N.occurrence_report(judged.withColumn("host", F.col("source_host"))), "articles")
        s.write(A.articles(judged), "interim", "articles")
        s.write(A.links(judged), "interim", "links")
    finally:
        judged.unpersist()
    C.enforce(C.unique(s.read("interim", "articles"), ["article_id"]), C.unique(s.read("interim", "links"), ["request_id", "article_id"]))


def build_news_contents(s: Season, a) -> None:
    out = N.contents(s.read("interim", "articles"), S.normalized_body(F.col("body")), "article_id", "source_host")
    s.report(N.duplicate_report(out), "contents")
    s.write(out, "interim", "contents")


def build_news_annotation_tasks(s: Season, a) -> None:
    bodies = s.read("interim", "articles").select("article_id", "source_host", S.prefixed_sha("content_sha256", S.normalized_body(F.col("body"))).alias("content_id"))
    links = s.read("interim", "links").join(bodies, "article_id")
    out = N.winners(links, ["request_id", "content_id"], ["request_article_index", "article_id"], "source_host")
    s.write(out.withColumn("task_id", S.json_array_id(1, F.lit(a.schema), F.col("request_id"), F.col("content_id"))), "interim", "tasks")


def build_news_features(s: Season, a) -> None:
    tasks, notes = s.read("interim", "context_tasks"), s.read("interim", "annotations")
    s.report(N.side_totals(N.context_quality(tasks, notes)), "annotations")
    s.write(N.side_features(notes), "processed", "news_features")


def _split(s: Season) -> tuple[DataFrame, DataFrame]:
    f = s.read("processed", "numerical_features")
    return f.filter("dataset_split = 'train'"), f.filter("dataset_split = 'test'")


def _scored(s: Season, out: DataFrame, name: str, columns: Sequence[str] = (), c: float | None = None) -> None:
    p = out.withColumnRenamed("result", "actual").withColumn("model", F.lit(name))
    C.enforce(C.probabilities(p, E.PROBS, ["match_id"]))
    s.write(p.select("match_id", "actual", "predicted", *E.PROBS), "processed", f"predictions_{name}")
    s.report(E.metrics(p, ["model"]), f"metrics_{name}")
    s.report(E.confusion(p, ["model"]), f"confusion_{name}")
    model = {"type": "prior"} if c is None else {"type": "multinomial logistic regression", "C": c}
    path = s.layout.path("processed", "numerical_features")
    report = P.report_document(P.evaluation_report(s.read("processed", "numerical_features"), p), name, s.season, columns, {"features": path}, model)
    store.write_bytes(s.layout.path("reports", f"evaluation_{name}.json"), (json.dumps(report, indent=2, ensure_ascii=False) + "\n").encode())


def evaluate_dummy(s: Season, a) -> None:
    train, test = _split(s)
    _scored(s, E.prior_predictions(train, test), "dummy")


def evaluate_reference(s: Season, a) -> None:
    train, test = _split(s)
    _fitted(s, X.fit_predict(train, test, {"reference": (M.FEATURES, 1.0)}), "reference", M.FEATURES, 1.0)


def _fitted(s: Season, out: tuple, name: str, columns: Sequence[str], c: float) -> None:
    s.write(X.coefficients(out[0], s.spark), "processed", f"coefficients_{name}")
    _scored(s, out[1], name, columns, c)


def _folds(last: int) -> Sequence[tuple[int, int, int]]:
    if last in FOLDS:
        return FOLDS[last]
    step = max(1, last // 6)
    return [(last - k * step, last - k * step + 1, last - (k - 1) * step) for k in (3, 2, 1)]


def select_configuration(s: Season, a) -> None:
    ranked, pred = selection.select(_split(s)[0], _folds(a.train_end), M.SETS, CS)
    C.enforce(selection.validation_violations(pred).select(F.lit("validation").alias("check"), F.col("match_id").cast("string").alias("key"), F.col("times").cast("string").alias("detail")))
    s.write(ranked, "processed", "selection")
    s.write(pred, "processed", "selection_predictions")


def evaluate_final(s: Season, a) -> None:
    train, test = _split(s)
    ranked = s.read("processed", "selection")
    best = ranked.filter("selection_rank = 1").first()
    name = best["model_id"].split("__")[1]
    _fitted(s, selection.final_model(train, test, ranked, M.SETS[name], best["c"], name), "final", M.SETS[name], best["c"])


def _news_columns(f: DataFrame) -> list[str]:
    return [c for c in f.columns if c.endswith(("_mean", "_share"))]


def evaluate_news_only(s: Season, a) -> None:
    n = s.read("processed", "news_features")
    train, test = (x.join(n, "match_id") for x in _split(s))
    columns, c = _news_columns(n), s.read("processed", "selection").filter("selection_rank = 1").first()["c"]
    _fitted(s, X.fit_predict(train, test, {"news": (columns, c)}), "news", columns, c)


def evaluate_combined(s: Season, a) -> None:
    n = s.read("processed", "news_features")
    C.enforce(C.covers(s.read("processed", "numerical_features"), n, ["match_id"]))
    train, test = (x.join(n, "match_id") for x in _split(s))
    best = s.read("processed", "selection").filter("selection_rank = 1").first()
    columns = [*M.SETS[best["model_id"].split("__")[1]], *_news_columns(n)]
    _fitted(s, X.fit_predict(train, test, {"combined": (columns, best["c"])}), "combined", columns, best["c"])


COMMANDS: dict[str, Callable] = {
    "build-matches": build_matches, "build-numerical-matches": build_numerical_matches, "build-numerical-features": build_numerical_features,
    "build-news-requests": build_news_requests, "export-news-source-review": export_news_source_review, "build-news-source-policy": build_news_source_policy,
    "build-news-articles": build_news_articles, "build-news-contents": build_news_contents, "build-news-annotation-tasks": build_news_annotation_tasks, "build-news-features": build_news_features,
    "evaluate-numerical-model-dummy": evaluate_dummy, "evaluate-numerical-model-reference": evaluate_reference, "select-numerical-model-configuration": select_configuration,
    "evaluate-numerical-model-final": evaluate_final, "evaluate-news-only-model": evaluate_news_only, "evaluate-combined-model": evaluate_combined,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--root", required=True)
    p.add_argument("--season", type=int, required=True)
    p.add_argument("--league", default="bl1")
    p.add_argument("--timezone", default="Europe/Berlin")
    p.add_argument("--lang", default="deu")
    p.add_argument("--schema", default="v3")
    p.add_argument("--overwrite", action="store_true", help="replace a review workbook that may hold a reviewer's work")
    p.add_argument("--train-end", type=int, default=27)
    p.add_argument("--last", type=int, default=34)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        COMMANDS[a.command](Season(spark, a.root, a.season), a)
    except (C.CheckFailed, selection.FrozenConfigurationChanged, ValueError, FileExistsError) as e:
        print(f"invalid data: {e}", file=sys.stderr)
        return 1
    except FileNotFoundError as e:
        print(f"missing file: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

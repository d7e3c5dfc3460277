"""Article, content, task and annotation operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .multinomial import settled

INDICATORS = ("i1", "i2", "i3", "i4")
SCALE = (-2, -1, 0, 1, 2)


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first rule that holds, in order; null where none does (nulls count as not holding)."""
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(F.coalesce(rule, F.lit(False)), name)
    return out


def with_policy(articles: DataFrame, policy: DataFrame) -> DataFrame:
    """Articles with their host's decision; hosts without a rule are ``unknown``."""
    return articles.join(policy.select("host", "decision"), "host", "left").withColumn("decision", F.coalesce("decision", F.lit("unknown")))


def judged(articles: DataFrame, policy: DataFrame, language: str, first_day: int, last_day: int) -> DataFrame:
    """Articles with ``reason``: why they are rejected, by the first rule of the chain that holds, or null."""
    a = with_policy(articles, policy)
    rules = [
        ("missing_source_host", F.col("host").isNull() | (F.col("host") == "")),
        ("policy_exclude", F.col("decision") == "exclude"),
        ("policy_unknown_host", F.col("decision") == "unknown"),
        ("missing_language", F.col("lang").isNull()),
        ("language_mismatch", F.col("lang") != language),
        ("date_outside_window", ~F.col("day_no").between(first_day, last_day)),
        ("invalid_article_url", S.canonical_url(F.col("url")).isNull()),
        ("missing_article_body", S.optional_text(F.col("text")).isNull()),
    ]
    return a.withColumn("reason", first_reason(rules))


def first_of_request(articles: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first occurrence of each key; later ones are duplicates."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return articles.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def occurrence_report(judged_articles: DataFrame) -> DataFrame:
    """``(kind, name, n)``: occurrences by decision, by reason and by host of rejected decisions, in one pass."""
    kinds = F.array(
        F.struct(F.lit("decision").alias("kind"), F.col("decision").alias("name")),
        F.struct(F.lit("reason").alias("kind"), F.coalesce("reason", F.lit("accepted")).alias("name")),
        F.when(F.col("decision") != "include", F.struct(F.concat("decision", F.lit("_host")).alias("kind"), F.col("host").alias("name"))),
    )
    return judged_articles.select(F.explode(kinds).alias("x")).filter(F.col("x").isNotNull()).groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))


def contents(articles: DataFrame, body: Column, article_id: str, host: str) -> DataFrame:
    """One row a content: id, least article as representative, members, distinct hosts.

    The bodies do not travel: groups form on the content's hash.
    """
    ided = articles.select(S.prefixed_sha("content_sha256", body).alias("content_id"), F.col(article_id).alias("article_id"), F.col(host).alias("host"))
    return ided.groupBy("content_id").agg(F.min("article_id").alias("representative"), F.count(F.lit(1)).alias("members"), F.count_distinct("host").alias("hosts"))


def duplicate_report(groups: DataFrame) -> DataFrame:
    many = F.col("members") > 1
    return groups.agg(
        F.count(F.lit(1)).alias("contents"), F.sum("members").alias("articles"), F.sum(F.col("members") - 1).alias("collapsed"),
        F.count_if(many).alias("groups"), F.coalesce(F.sum(F.when(many, F.col("members"))), F.lit(0)).alias("grouped"),
        F.count_if(many & (F.col("hosts") > 1)).alias("cross_source"), F.max("members").alias("largest"),
    )


def winners(links: DataFrame, keys: Sequence[str], order: Sequence[str], host: str) -> DataFrame:
    """Per key the first link by ``order``, with the number of links and distinct hosts."""
    return links.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("links"), F.count_distinct(host).alias("hosts")).select(*keys, *[F.col(f"_first.{o}").alias(f"winner_{o}") for o in order], "links", "hosts")


def indicator_summary(notes: DataFrame, keys: Sequence[str], indicators: Sequence[str] = INDICATORS) -> DataFrame:
    """Per group and indicator: successes, mentions, share, mean of mentions (0.0 if none) and counts by rating."""
    long = notes.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).alias("rating")) for i in indicators])).alias("x")).select(*keys, "x.*")
    n, m = F.count(F.lit(1)), F.count("rating")
    return long.groupBy(*keys, "indicator").agg(
        n.alias("successes"), m.alias("mentions"), (n - m).alias("not_mentioned"),
        F.round(m / n, 6).alias("share"), F.coalesce(F.round(F.sum("rating") / m, 6), F.lit(0.0)).alias("mean"),
        *[F.count_if(F.col("rating") == v).alias(f"n_{'m' if v < 0 else 'p'}{abs(v)}") for v in SCALE],
    )


def side_features(notes: DataFrame, indicators: Sequence[str] = INDICATORS) -> DataFrame:
    """One row a match: for each side and indicator the mean rating and the mention share (conditional aggregates)."""
    out = []
    for side in ("home", "away"):
        here = F.col("side") == side
        for i in indicators:
            n, m = F.count_if(here), F.count(F.when(here, F.col(i)))
            out.append(F.coalesce(F.round(F.try_divide(F.sum(F.when(here, F.col(i))), m), 6), F.lit(0.0)).alias(f"{side}_{i}_mean"))
            out.append(F.coalesce(F.round(F.try_divide(m, n), 6), F.lit(0.0)).alias(f"{side}_{i}_share"))
    return notes.groupBy("match_id").agg(*out)


def context_quality(tasks: DataFrame, notes: DataFrame) -> DataFrame:
    """Per match and side: tasks expected, annotated and missing, the coverage, and the missing ids in order."""
    j = tasks.select("match_id", "side", "task_id").join(notes.select("task_id", F.lit(True).alias("_done")), "task_id", "left")
    return j.groupBy("match_id", "side").agg(
        F.count(F.lit(1)).alias("expected"), F.count("_done").alias("annotated"), F.count_if(F.col("_done").isNull()).alias("missing"),
        F.round(F.count("_done") / F.count(F.lit(1)), 6).alias("coverage"), F.array_sort(F.collect_list(F.when(F.col("_done").isNull(), F.col("task_id")))).alias("missing_ids"),
    )


def side_totals(quality: DataFrame) -> DataFrame:
    """Totals by side and over both, in one pass of grouping sets."""
    return quality.rollup("side").agg(F.count(F.lit(1)).alias("contexts"), F.sum("expected").alias("expected"), F.sum("annotated").alias("annotated"), F.round(F.sum("annotated") / F.sum("expected"), 6).alias("coverage")).withColumn("side", F.coalesce("side", F.lit("all")))


def agreement(first: DataFrame, second: DataFrame, indicators: Sequence[str] = INDICATORS) -> DataFrame:
    """Per task of both runs, in long form: indicator, both ratings and how they differ."""
    a = first.select("task_id", *[F.col(i).alias(f"a_{i}") for i in indicators])
    b = second.select("task_id", *[F.col(i).alias(f"b_{i}") for i in indicators])
    rows = F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(f"a_{i}").alias("a"), F.col(f"b_{i}").alias("b")) for i in indicators])
    return a.join(b, "task_id").select("task_id", F.explode(rows).alias("x")).select("task_id", "x.*").withColumn("kind", S.difference_kind(F.col("a"), F.col("b")))


def pending(tasks: DataFrame, done: DataFrame, failed: DataFrame, retry_only: bool = False, key: str = "task_id") -> DataFrame:
    """Tasks still to do: neither done nor deferred by a failure; with ``retry_only`` just the deferred ones."""
    rest = tasks.join(done.select(key).distinct(), key, "left_anti")
    return rest.join(failed.select(key).distinct(), key, "left_semi" if retry_only else "left_anti")


def next_sequence(new: DataFrame, log: DataFrame, key: str = "task_id", order: str = "recorded") -> DataFrame:
    """New failures numbered on from each key's latest in the log."""
    last = log.groupBy(key).agg(F.max("sequence").alias("_last"))
    w = Window.partitionBy(key).orderBy(order)
    return new.join(last, key, "left").withColumn("sequence", (F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).cast("long")).drop("_last")


def length_bins(tasks: DataFrame, length: Column, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``bin`` of each row: how many quantile boundaries its length reaches. A boundary is the sorted length at
    ``round((n - 1) q)``, half to even; boundaries come from a table of distinct lengths, not from a global sort."""
    rows = tasks.withColumn("_len", length)
    hist = rows.groupBy("_len").count()
    upto = hist.select("_len", F.sum("count").over(Window.partitionBy(F.lit(1)).orderBy("_len")).alias("upto"), F.sum("count").over(Window.partitionBy(F.lit(1))).alias("n"))
    bounds = upto.agg(F.array(*[F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * q, 0), F.col("_len"))) for q in quantiles]).alias("_b"))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("bin", F.size(F.filter("_b", lambda b: b <= F.col("_len")))).drop("_b", "_len")


def seeded_order(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


BALANCED = ("team_id", "content_id", "bin", "side", "source_host")
MOST_CANDIDATES = 1_000_000


def day_quotas(days: DataFrame, size: int, seed: int, day: str) -> DataFrame:
    """``(day, rank, quota)`` of distinct days: ``size`` picks spread over them.

    With a pick or more for each day all get the same, and the remainder goes to days in a row, beginning with the
    one at the seed's remainder and going round. With fewer picks than days they stand at even distances from the
    first day to the last (halves to the even rank); a single one stands at the seed's remainder.
    """
    w = Window.partitionBy(F.lit(1))
    ranked = days.withColumns({"rank": F.row_number().over(w.orderBy(day)) - 1, "_m": F.count(F.lit(1)).over(w)})
    even = F.floor(F.lit(size) / F.col("_m")) + (F.pmod(F.col("rank") - seed, F.col("_m")) < F.lit(size) % F.col("_m")).cast("int")
    spots = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.bround(i * (F.col("_m") - 1) / F.lit(max(size - 1, 1)), 0).cast("int"))
    sparse = F.size(F.filter(spots, lambda x: x == F.col("rank"))) if size > 1 else (F.col("rank") == F.lit(seed) % F.col("_m")).cast("int")
    return ranked.select(day, "rank", F.when(F.lit(size) >= F.col("_m"), even).otherwise(sparse).cast("int").alias("quota"))


def _picks(rank: np.ndarray, quota: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Rows in the order of choice. Rows are sorted by hash; ``codes`` has a column for each balanced property.

    The schedule takes one row for each day with quota left, day after day and round after round. A pick narrows its
    day's free rows property by property to those whose value was used least so far; the first by hash is taken.
    """
    used = [np.zeros(c.max() + 1, np.int64) for c in codes.T]
    days = {d: np.flatnonzero(rank == d) for d in np.unique(rank[quota > 0]).tolist()}
    limit = {d: int(quota[rows[0]]) for d, rows in days.items()}
    schedule = [d for k in range(max(limit.values(), default=0)) for d in sorted(days) if limit[d] > k and len(days[d]) > k]
    free = np.ones(len(rank), bool)
    taken = np.empty(len(schedule), np.int64)
    for at, d in enumerate(schedule):
        rows = days[d][free[days[d]]]
        for counts, c in zip(used, codes.T):
            seen = counts[c[rows]]
            rows = rows[seen == seen.min()]
        taken[at] = pick = rows[0]
        free[pick] = False
        for counts, c in zip(used, codes[pick]):
            counts[c] += 1
    return taken


def _contenders(rows: DataFrame, size: int, day: str, balanced: Sequence[str]) -> DataFrame:
    """The rows that some pick can take; ``_h`` orders them.

    Take the rows of one day that agree in the columns of few values, and of these the fresh ones: first by hash with
    each of their values in the other columns, so no two share one. A pick made before uses up one value a column, so
    it spoils at most one fresh row for each of the ``many`` columns. Of ``many * (size - 1) + 1`` fresh rows one is
    free and has unused values alone, and a row after all of them by hash cannot come before it.
    """
    few_at_most = 64
    counts = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in balanced]).first()
    many = [c for c in balanced if counts[c] > few_at_most]
    if not many:
        return rows
    group = [day, *[c for c in balanced if c not in many]]
    same = lambda cols: [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols]
    fresh = rows.select(*group, *many, "_h")
    for c in many:
        fresh = fresh.alias("l").join(rows.groupBy(*group, c).agg(F.min("_h").alias("_h")).alias("r"), same([*group, c, "_h"]), "left_semi")
    need = len(many) * (size - 1) + 1
    # the first ``need`` of a group, by way of the first of each of its slices
    for by in ([F.pmod(F.xxhash64("_h"), F.lit(64))], []):
        fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*group, *by).orderBy("_h"))).filter(F.col("_n") <= need)
    last = fresh.filter(F.col("_n") == need).select(*group, F.col("_h").alias("_last"))
    kept = rows.alias("l").join(last.alias("r"), same(group), "left").filter(F.col("_last").isNull() | (F.col("_h") <= F.col("_last")))
    return kept.select("l.*")


def stratified_sample(tasks: DataFrame, size: int, seed: int = 42, id_col: str = "task_id", day: str = "matchday", balanced: Sequence[str] = BALANCED) -> DataFrame:
    """A deterministic pilot of ``size`` tasks with their ``position``, balanced over the given columns day by day.

    Quotas and candidates are tables: of every combination of the balanced columns a day keeps as many rows, first by
    seeded hash, as its quota, and of these only those that can still be chosen (``_contenders``). The choice itself is
    sequential and runs in one task, which refuses more than MOST_CANDIDATES rows. A size of at least all tasks gives all of them, in the order of their ids; a day with fewer
    tasks than its quota gives those it has.
    """
    if size < 1:
        raise ValueError("the size must be positive")
    if tasks.limit(size + 1).count() <= size:
        return tasks.withColumn("position", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(id_col)) - 1).cast("int"))
    quotas = day_quotas(tasks.select(day).distinct(), size, seed, day)
    first = Window.partitionBy(day, *balanced).orderBy("_h")
    rows = tasks.select(id_col, day, *balanced, seeded_order(F.col(id_col), seed).alias("_h")).join(F.broadcast(quotas), day).filter("quota > 0")
    rows = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= F.col("quota"))
    rows = _contenders(settled(rows), size, day, balanced)
    code = lambda c: F.xxhash64(F.col(c).cast("string")).alias(f"_c{c}")
    rows = rows.select(F.lit(0).alias("_one"), id_col, "rank", "quota", "_h", *map(code, balanced))

    def choose(t: pd.DataFrame) -> pd.DataFrame:
        if len(t) > MOST_CANDIDATES:
            raise ValueError(f"more than {MOST_CANDIDATES} candidates for a sequential choice")
        t = t.sort_values("_h", kind="stable").reset_index(drop=True)
        codes = np.stack([pd.factorize(t[f"_c{c}"])[0] for c in balanced], axis=1)
        at = _picks(t["rank"].to_numpy(), t["quota"].to_numpy(), codes)
        return pd.DataFrame({id_col: t[id_col].to_numpy()[at], "position": np.arange(len(at), dtype=np.int32)})

    kind = tasks.schema[id_col].dataType.simpleString()
    order = rows.groupBy("_one").applyInPandas(choose, f"{id_col} {kind}, position int")
    return tasks.join(order, id_col)

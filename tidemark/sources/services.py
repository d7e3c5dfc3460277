"""Connectors with injectable transports: match and statistics services, article search, annotators.

Nothing here opens a connection by itself: a transport is a callable that the caller passes in.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Reply(NamedTuple):
    status: int
    body: str


def season_code(season: int) -> str:
    return f"{season % 100:02d}{(season + 1) % 100:02d}"


def stats_url(base: str, season: int, division: str = "D1") -> str:
    return f"{base}/{season_code(season)}/{division}.csv"


def api_key(environ: dict[str, str], env_text: str, name: str) -> str:
    """From the environment, else from ``NAME=value`` lines; quotes and ``export`` are taken off."""
    if environ.get(name, "").strip():
        return environ[name].strip()
    for line in env_text.splitlines():
        key, sep, value = line.strip().removeprefix("export ").partition("=")
        if sep and key.strip() == name and (v := value.strip().strip("'\"")):
            return v
    raise KeyError(f"{name} is not set")


def valid_response(body: str | Column) -> Column:
    """An object whose ``articles`` is an object with a list of results (which may be empty)."""
    b = F.col(body) if isinstance(body, str) else body
    results = F.get_json_object(b, "$.articles.results")
    return F.coalesce(F.try_parse_json(b).isNotNull() & results.startswith("[") & (F.from_json(results, "array<map<string,string>>").isNotNull() | (F.regexp_replace(results, r"\s", "") == "[]")), F.lit(False))


def fetch(requests: DataFrame, done: DataFrame | None, post: Callable[[str], Reply], retries: int = 3, wait: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``(request_id, status, body, attempts, ok)`` of requests without a valid response; status 429 is retried."""
    todo = requests if done is None else requests.join(done.filter(valid_response("body")).select("request_id"), "request_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, payload in zip(b["request_id"], b["payload"]):
                reply, n = post(payload), 1
                while reply.status == 429 and n <= retries:
                    sleep(wait)
                    reply, n = post(payload), n + 1
                out.append((rid, reply.status, reply.body, n, reply.status == 200))
            yield pd.DataFrame(out, columns=["request_id", "status", "body", "attempts", "ok"])

    return todo.select("request_id", "payload").mapInPandas(run, "request_id string, status int, body string, attempts int, ok boolean")


def annotator(chat: Callable[[str], str], indicators: tuple[str, ...], ratings: tuple[str, ...], attempts: int = 2) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """An annotator for ``streaming.logs``: asks, validates, asks once more with the error, else reports it."""

    def check(text: str) -> dict:
        got = json.loads(text)
        if not isinstance(got, dict) or set(got) != set(indicators):
            raise ValueError("wrong keys")
        for k, v in got.items():
            if set(v) != {"rating", "evidence"} or v["rating"] not in ratings or len(v["evidence"]) > 2 or (not v["evidence"]) != (v["rating"] == "not_mentioned"):
                raise ValueError(f"bad {k}")
        return got

    def run(tasks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tid, body in zip(tasks["task_id"], tasks["body"]):
            prompt, error, got = body, None, None
            for n in range(1, attempts + 1):
                try:
                    got, error = check(chat(prompt)), None
                    break
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    error = str(e)
                    prompt = f"{body}\n\nThe last answer was refused: {error}"
            out.append((tid, None if got is None else json.dumps(got), error, n))
        return pd.DataFrame(out, columns=["task_id", "answer", "error", "attempts"])

    return run


def response_ok(answer: Column, indicators: tuple[str, ...], ratings: tuple[str, ...]) -> Column:
    """The same rules as an expression over stored answers."""
    kind = "struct<" + ",".join(f"{i}:struct<rating:string,evidence:array<string>>" for i in indicators) + ">"
    a = F.from_json(answer, kind)
    keys = F.array_sort(F.json_object_keys(answer)) == F.array(*[F.lit(i) for i in sorted(indicators)])
    rules = keys
    for i in indicators:
        n = F.size(a[i]["evidence"])
        rules = rules & a[i]["rating"].isin(*ratings) & (n <= 2) & ((n == 0) == (a[i]["rating"] == "not_mentioned"))
    return F.coalesce(rules, F.lit(False))

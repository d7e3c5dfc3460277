"""Services as Spark data sources: posting requests through a writer that commits once, reading a match service in
planned partitions. Transports are callables that the caller passes in; they go to the tasks with the source.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product
from queue import SimpleQueue
from threading import Lock, Thread

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from . import store
from .services import Reply

TOO_MANY = 429
LOG = "request_id string, status int, article_count long, raw_path string"


class ResponseRefused(RuntimeError):
    """A reply that is neither good nor worth another try."""


def article_count(body: str) -> int | None:
    """The number of results of a valid response, None for any other text."""
    try:
        results = json.loads(body)["articles"]["results"]
    except (ValueError, KeyError, TypeError):
        return None
    return len(results) if isinstance(results, list) else None


@dataclass
class Committed(WriterCommitMessage):
    part: str
    fetched: int


def response_sink(post: Callable[[str], Reply], count: Callable[[str], int | None] = article_count, retries: int = 3, wait: float = 10.0, delay: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """A data source to write requests ``(request_id, payload)`` to: ``format("responses").option("path", ...)``.

    Each reply's bytes are stored as ``raw/<request_id>.json`` before the next request goes out, so neither another attempt
    of the task nor a later run posts it again. A task lists its replies in a part of its own; the commit names the
    parts of the attempts that succeeded in one file ``commits/<run>.json``, and only those count (``committed_log``). An
    aborted run leaves no part and no commit, but the replies that it paid for. With ``option("lease", number)`` a writer whose
    lease was taken over cannot commit. Status 429 is tried again after ``wait``; any other failure ends the run.
    """

    class Writer(DataSourceWriter):
        def __init__(self, options: dict):
            self.path, self.run, self.lease = options["path"].rstrip("/"), uuid.uuid4().hex, options.get("lease")

        def write(self, iterator: Iterator) -> Committed:
            lines, posted = [], 0
            for request in iterator:
                raw = f"{self.path}/raw/{store.file_name(request['request_id'])}.json"
                known = store.read_bytes(raw)
                n = None if known is None else count(known.decode())
                if n is None:
                    if posted and delay:
                        sleep(delay)
                    reply, tries = post(request["payload"]), 0
                    while reply.status == TOO_MANY and tries < retries:
                        sleep(wait)
                        reply, tries = post(request["payload"]), tries + 1
                    posted += 1
                    n = count(reply.body) if reply.status == 200 else None
                    if n is None:
                        raise ResponseRefused(f"request {request['request_id']}: status {reply.status}, {reply.body[:100]!r}")
                    store.write_bytes(raw, reply.body.encode())
                lines.append(json.dumps({"request_id": request["request_id"], "status": 200, "article_count": n, "raw_path": raw}))
            part = f"{self.run}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.jsonl"
            if lines:
                store.write_bytes(f"{self.path}/parts/{part}", ("\n".join(lines) + "\n").encode())
            return Committed(part if lines else "", len(lines))

        def commit(self, messages: list) -> None:
            if self.lease is not None:
                store.check_fence(self.path, int(self.lease))
            done = [m for m in messages if m is not None and m.part]
            body = {"run": self.run, "parts": [m.part for m in done], "fetched": sum(m.fetched for m in done)}
            store.write_bytes(f"{self.path}/commits/{self.run}.json", json.dumps(body).encode())

        def abort(self, messages: list) -> None:
            for name in store.listed(f"{self.path}/parts"):
                if name.startswith(self.run):
                    store.delete(f"{self.path}/parts/{name}")

    class Responses(DataSource):
        @classmethod
        def name(cls) -> str:
            return "responses"

        def schema(self) -> str:
            return "request_id string, payload string"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return Writer(dict(self.options))

    return Responses


def post_all(requests: DataFrame, path: str, sink: type[DataSource], lease: store.Lease | None = None, tasks: int | None = None) -> None:
    """Post the requests that no committed run lists, and commit them as one run; replies that an aborted run left are
    listed without posting. ``tasks`` of them post at a time, one for each core where that is not said."""
    spark = requests.sparkSession
    spark.dataSource.register(sink)
    todo = requests.select("request_id", "payload").join(committed_log(spark, path).select("request_id"), "request_id", "left_anti")
    todo = todo.repartition(tasks or spark.sparkContext.defaultParallelism, "request_id")
    writer = todo.write.format("responses").mode("append").option("path", path)
    (writer.option("lease", str(lease.number)) if lease else writer).save()


def committed_log(spark: SparkSession, path: str) -> DataFrame:
    """``(request_id, status, article_count, raw_path)`` of all committed runs."""
    names = store.listed(f"{path}/commits")
    parts = [f"{path}/parts/{p}" for n in names for p in json.loads(store.read_bytes(f"{path}/commits/{n}"))["parts"]]
    return spark.read.schema(LOG).json(parts) if parts else spark.createDataFrame([], LOG)


# matches ---------------------------------------------------------------------------------------------------


@dataclass
class SeasonPart(InputPartition):
    league: str
    season: int

    def __init__(self, league: str, season: int):
        super().__init__((league, season))
        self.league, self.season = league, season


def match_service(get: Callable[[str, int], str], seasons: list[tuple[str, int]], schema: str) -> type[DataSource]:
    """A data source ``match_service`` of ``(league, season, match)`` with one partition for each given season.

    ``get(league, season)`` returns the service's text: a list of objects, of which ``schema`` names the fields. Equality and
    membership filters on league and season are pushed down, so seasons that are not asked for are not fetched.
    """

    class Reader(DataSourceReader):
        def __init__(self):
            self.asked: dict[str, set] = {}

        def pushFilters(self, filters: list) -> Iterator:
            for f in filters:
                column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
                if column in ("league", "season"):
                    values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.asked[column] = self.asked.get(column, values) & values
                else:
                    yield f

        def partitions(self) -> list[InputPartition]:
            wanted = lambda column, v: column not in self.asked or v in self.asked[column]
            return [SeasonPart(a, b) for a, b in seasons if wanted("league", a) and wanted("season", b)] or [SeasonPart("", -1)]

        def read(self, partition: SeasonPart) -> Iterator[tuple]:
            if partition.season < 0:
                return
            found = json.loads(get(partition.league, partition.season))
            if not isinstance(found, list) or not all(isinstance(m, dict) for m in found):
                raise ValueError(f"{partition.league} {partition.season}: not a list of objects")
            for m in found:
                yield (partition.league, partition.season, json.dumps(m, ensure_ascii=False))

    class Matches(DataSource):
        @classmethod
        def name(cls) -> str:
            return "match_service"

        def schema(self) -> str:
            return "league string, season int, match string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    Matches.fields = schema
    return Matches


def read_matches(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    """The service's matches with their fields as columns beside ``league`` and ``season``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    raw = spark.read.format("match_service").load()
    return raw.select("league", "season", F.from_json("match", source.fields, {"mode": "FAILFAST"}).alias("m")).select("league", "season", "m.*")


# a window of requests ----------------------------------------------------------------------------------------

_END = object()


def in_flight(items, call: Callable, workers: int) -> Iterator[tuple]:
    """``(item, result, error)`` in the order of completion, with at most ``workers`` calls open at any time.

    Items are drawn as calls end, never ahead. An error is a result like any other; if the items themselves fail, that
    error is raised after what is open has come in.
    """
    source, turn, out = iter(items), Lock(), SimpleQueue()
    over: list = []

    def work() -> None:
        while True:
            with turn:
                try:
                    item = _END if over else next(source, _END)
                except Exception as e:
                    over.append(e)
                    item = _END
            if item is _END:
                out.put(_END)
                return
            try:
                out.put((item, call(item), None))
            except Exception as e:
                out.put((item, None, e))

    threads = [Thread(target=work, daemon=True) for _ in range(workers)]
    for t in threads:
        t.start()
    left = workers
    try:
        while left:
            got = out.get()
            if got is _END:
                left -= 1
            else:
                yield got
    finally:
        over.append(None)  # whoever stops reading stops the drawing
    if over[0] is not None:
        raise over[0]


def call_in_flight(tasks: DataFrame, key: str, body: str, call: Callable[[str], str], workers: int = 4, flush: int = 64) -> DataFrame:
    """``(key, answer, error)`` of a call on each row's body, ``workers`` at a time in each task, in order of completion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], kind), pa.array([h[1] for h in held], pa.string()), pa.array([h[2] for h in held], pa.string())], [key, "answer", "error"])

        for row, answer, error in in_flight(rows, lambda r: call(r[body]), workers):
            held.append((row[key], answer, None if error is None else f"{type(error).__name__}: {error}"))
            if len(held) >= flush:
                yield batch()
                held.clear()
        if held:
            yield batch()

    named = tasks.schema[key].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[named]
    return tasks.select(key, body).mapInArrow(run, f"`{key}` {named}, answer string, error string")

"""Stateful streams in event order: rolling features a team and a season, the log of a task.

Rows of a key may come in any order within the watermark. They wait in state; a timer at the earliest of them fires
when the watermark has passed it, and then all rows that cannot be overtaken any more are taken in order. State is asked
for through a socket, at milliseconds a group, so SHARE neighbouring keys make one group: their rows wait together and
their totals stand side by side. A batch touches the groups that it holds rows or due timers of, whatever went before.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARE = 32  # keys a group: those whose last column lies in one span of SHARE numbers
ROW = ["member", "at", "unnamed", "id", "value"]  # a waiting row; ``unnamed`` is 1 where the id is null, which sorts last


class Runs:
    """Rows in the order of their members: where each member's run starts, and each row's place in its run."""

    def __init__(self, member: np.ndarray):
        self.starts = np.flatnonzero(np.r_[True, member[1:] != member[:-1]])
        self.members = member[self.starts]
        self.counts = np.diff(np.r_[self.starts, len(member)])
        self.place = np.arange(len(member)) - self.each(self.starts)

    def each(self, of_run: np.ndarray) -> np.ndarray:
        """A value of each run, given to each of its rows."""
        return np.repeat(of_run, self.counts)


class Ordered(StatefulProcessor):
    """Takes each key's rows ``(at, id, value)`` in the order of ``(at, id)``; subclasses say what rows do to the state.

    A group's key ends with the least number of its span; a row's ``member`` is what its own key lies above that."""

    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "rows binary")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Make the state of the subclass."""

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Rows in the order of ``(member, at, id)``: those that have results, and these."""
        raise NotImplementedError

    def _pending(self) -> np.ndarray:
        held = self.waiting.get()
        return np.frombuffer(held[0] if held else b"", "<i8").reshape(-1, len(ROW))

    def _keep(self, rows: np.ndarray) -> None:
        if len(rows):
            self.waiting.update((rows.astype("<i8").tobytes(),))
            self.handle.registerTimer(int(rows[:, 1].min()) // 1000)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [self._pending()]
        for b in rows:
            at = b["at"].astype("datetime64[us]").astype("int64")
            held.append(b.assign(at=at).reindex(columns=ROW, fill_value=0).to_numpy("int64"))
        yield from self._settle(key, np.concatenate(held), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, self._pending(), timerValues, changed=False)

    def _settle(self, key, held: np.ndarray, timerValues, changed: bool = True) -> Iterator[pd.DataFrame]:
        """Take what the watermark has passed and let the rest wait."""
        passed = held[:, 1] // 1000 <= timerValues.getCurrentWatermarkInMs()
        if changed or passed.any():
            self._keep(held[~passed])
        if passed.any():
            due = held[passed]
            due, results = self.take(due[np.lexsort((due[:, 3], due[:, 2], due[:, 1], due[:, 0]))])
            if len(due):
                ids = pd.arrays.IntegerArray(due[:, 3].copy(), due[:, 2] != 0)
                out = dict(zip(self.columns, key[:-1])) | {self.columns[len(key) - 1]: key[-1] + due[:, 0], "id": ids} | results
                yield pd.DataFrame(out, columns=list(self.columns))

    def close(self) -> None:
        pass


class Rolling(Ordered):
    """Before each row: how many rows the key had, their sum, and the sum of the last ``form``."""

    columns = ("season", "team", "id", "played", "points", "form_points")

    def __init__(self, form: int = 5):
        self.form = form

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "played array<long>, points array<long>")
        self.last = handle.getListState("last", "points array<long>")

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        held, form = self.totals.get(), self.form
        played, points = np.array(held, "int64") if held else np.zeros((2, SHARE), "int64")
        last = np.array([r[0] for r in self.last.get()], "int64") if held else np.zeros((form, SHARE), "int64")
        member, value = rows[:, 0], rows[:, -1]
        runs = Runs(member)
        before = np.cumsum(value) - value
        # each run with the member's last values put before it, and the sums up to each place
        line = np.insert(value, np.repeat(runs.starts, form), last[:, runs.members].T.ravel())
        sums = np.r_[0, np.cumsum(line)]
        at = np.arange(len(rows)) + form * (1 + runs.each(np.arange(len(runs.starts))))
        out = {"played": played[member] + runs.place, "points": points[member] + before - runs.each(before[runs.starts]), "form_points": sums[at] - sums[at - form]}
        played[runs.members] += runs.counts
        points[runs.members] += np.add.reduceat(value, runs.starts)
        ends = at[runs.starts + runs.counts - 1] + 1
        last[:, runs.members] = line[ends - form + np.arange(form)[:, None]]
        self.totals.update((played.tolist(), points.tolist()))
        self.last.put([(v,) for v in last.tolist()])
        return rows, out


class TaskLog(Ordered):
    """Outcomes of a task (``value`` 1: annotated, 0: failed): failures numbered upwards until the first success, that
    success, and nothing after it."""

    columns = ("task", "id", "kind", "sequence")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "done array<long>, failures array<long>")

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        held = self.seen.get()
        done, failures = np.array(held, "int64") if held else np.zeros((2, SHARE), "int64")
        member, good = rows[:, 0], rows[:, -1] != 0
        runs = Runs(member)
        first = np.minimum.reduceat(np.where(good, runs.place, len(rows)), runs.starts)  # place of a run's first success
        told = (runs.place <= runs.each(first)) & (done[member] == 0)
        out = {"kind": np.where(good, "annotation", "failure"), "sequence": np.where(good, 0, failures[member] + runs.place + 1)}
        done[runs.members] |= first < len(rows)
        failures[runs.members] += np.minimum(first, runs.counts)
        self.seen.update((done.tolist(), failures.tolist()))
        return rows[told], {c: v[told] for c, v in out.items()}


def _stateful(stream: DataFrame, keys: list[str], processor: Ordered, schema: str, delay: str) -> DataFrame:
    """``stream`` is ``(keys, at, id, value)``; rows that come later than ``delay`` after the newest are dropped by Spark."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    member = F.pmod(keys[-1], F.lit(SHARE))
    named = {"unnamed": F.col("id").isNull().cast("long"), "id": F.coalesce("id", F.lit(0)), "value": F.coalesce("value", F.lit(0))}
    rows = stream.withWatermark("at", delay).withColumns({"member": member, keys[-1]: F.col(keys[-1]) - member} | named)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def rolling_features(stream: DataFrame, delay: str, form: int = 5) -> DataFrame:
    """``(season, team, id, played, points, form_points)`` of a stream ``(season, team, at, id, value)``."""
    return _stateful(stream, ["season", "team"], Rolling(form), "season int, team long, id long, played long, points long, form_points long", delay)


def task_log(stream: DataFrame, delay: str) -> DataFrame:
    """``(task, id, kind, sequence)`` of a stream of outcomes ``(task, at, id, value)``."""
    return _stateful(stream, ["task"], TaskLog(), "task long, id long, kind string, sequence long", delay)


def drained(out: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that its source holds now, into Parquet at ``path``/out, and read that."""
    spark: SparkSession = out.sparkSession
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def closing(key_columns: dict, at: datetime, spark: SparkSession, schema: str) -> DataFrame:
    """A row past the end of a finished stream: it moves the watermark on, so that all rows before it are taken."""
    return spark.createDataFrame([(*key_columns.values(), at, -1, 0)], schema)

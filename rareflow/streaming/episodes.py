"""Stateful streams over runs: where each run ends, and the control law carried from one micro-batch to the next.

Both keep rows in order by event time: a row acts once the watermark has passed it, when no earlier one can arrive any
more. So the results don't depend on how the rows are cut into micro-batches; only rows later than the watermark drop.
State is kept for shares of the runs (``SHARES`` of them, by the run's hash), not for each: a call to Python, a state read
and a timer for every run cost milliseconds each, and runs may be many and short. The session needs the RocksDB state
store (``with_state``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.control import ControlLaw
from ..operators.telemetry import SILENT, end_reason

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Shares of the runs; the state of one is in memory at a time.
SHARES = 1024


def with_state(spark: SparkSession) -> None:
    """Names the state store that keyed state with timers needs, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def due(ts: pd.Series) -> pd.Series:
    """The first whole millisecond after a time: a watermark of that value has passed it."""
    return ts.astype("datetime64[us]").astype("int64") // 1000 + 1


def only_timer(handle: StatefulProcessorHandle, at: int) -> None:
    """The key's one timer: any other goes."""
    for old in list(handle.listTimers()):
        if old != at:
            handle.deleteTimer(old)
    handle.registerTimer(at)


def no_timer(handle: StatefulProcessorHandle) -> None:
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)


def shared_out(run: str) -> list[Column]:
    """The share of a run and its number; rows without a run are one run, alone in share -1."""
    share = F.when(F.col(run).isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(run), F.lit(SHARES)))
    return [share.alias("share"), F.coalesce(F.col(run), F.lit(0)).cast("long").alias(run)]


def with_run(out: pd.DataFrame, key: Any, run: str) -> pd.DataFrame:
    return out if key[0] >= 0 else out.assign(**{run: pd.Series([None] * len(out), index=out.index, dtype="Int64")})


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(held: bytes) -> pa.Table:
    return pa.ipc.open_stream(held).read_all()


class EpisodeEnds(StatefulProcessor):
    """One row for each run: its first end, or its last step once the run has been silent for ``gap_ms``.

    An ended run is remembered until it is silent, so that its later steps open no new episode. After a silence the
    same key begins a new one.
    """

    COLUMNS = {"ended": "bool", "end_step": "int64", "reason": "object", "end_due": "int64", "last_step": "int64", "last_due": "int64", "told": "bool"}

    def __init__(self, gap_ms: int, run: str) -> None:
        self.gap_ms, self.run = gap_ms, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("episodes", "held binary")

    def runs(self) -> pd.DataFrame:
        """What is known of each run, by run."""
        if self.state.exists():
            return unpacked(self.state.get()[0]).to_pandas().set_index(self.run)
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in self.COLUMNS.items()}, index=pd.Index([], dtype="int64", name=self.run))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat([batch.assign(due=due(batch["ts"])) for batch in rows])
        last = new.groupby(self.run).agg(step=("step", "max"), due=("due", "max"))
        ends = new[new["reason"].notna()].sort_values("step", kind="stable").drop_duplicates(self.run).set_index(self.run)
        held = self.runs()
        every, least = held.index.union(last.index).rename(self.run), np.iinfo("int64").min
        blank = {"bool": False, "object": "", "int64": least}
        held = pd.DataFrame({c: held[c].reindex(every, fill_value=blank[t]) for c, t in self.COLUMNS.items()})
        for known, seen in (("last_step", "step"), ("last_due", "due")):
            held[known] = np.maximum(held[known], last[seen].reindex(every, fill_value=least))
        step = ends["step"].reindex(every, fill_value=least)
        first = every.isin(ends.index) & ~held["told"] & (~held["ended"] | (step < held["end_step"]))
        held["end_step"] = held["end_step"].where(~first, step)
        held["end_due"] = held["end_due"].where(~first, ends["due"].reindex(every, fill_value=least))
        held["reason"] = held["reason"].where(~first, ends["reason"].reindex(every, fill_value=""))
        held["ended"] |= first
        yield from self.passed(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self.passed(key, self.runs(), timerValues.getCurrentWatermarkInMs())

    def passed(self, key: Any, held: pd.DataFrame, now: int) -> Iterator[pd.DataFrame]:
        """Tells the ends that the watermark has passed, forgets the runs that are silent, and keeps the others."""
        silent = held["last_due"] + self.gap_ms <= now
        tell = held["ended"] & ~held["told"] & (held["end_due"] <= now)
        over = ~held["ended"] & silent
        out = pd.concat([
            pd.DataFrame({"end_step": held["end_step"][tell], "reason": held["reason"][tell]}),
            pd.DataFrame({"end_step": held["last_step"][over], "reason": SILENT})])
        held = held.assign(told=held["told"] | tell)[~silent]
        if len(held):
            self.state.update((packed(pa.Table.from_pandas(held.reset_index(), preserve_index=False)),))
            only_timer(self.handle, int(np.where(held["ended"] & ~held["told"], held["end_due"], held["last_due"] + self.gap_ms).min()))
        else:
            self.state.clear()
            no_timer(self.handle)
        if len(out):
            yield with_run(out.rename_axis(self.run).reset_index(), key, self.run)


def episode_ends(steps: DataFrame, late: str, gap_ms: int, max_xte: float, max_seconds: float, run: str = "run_id") -> DataFrame:
    """run, end_step, reason of a stream of steps (run, step, ts, xte, elapsed, done, beyond_end), as ``telemetry.episode_end`` has them.

    A run's row comes once the watermark, ``late`` behind the newest row, has passed its end, or its last step by
    ``gap_ms``. Steps of a run must be in the order of their times.
    """
    rows = steps.withWatermark("ts", late).select(*shared_out(run), "step", "ts", end_reason(max_xte, max_seconds).alias("reason"))
    return rows.groupBy("share").transformWithStateInPandas(EpisodeEnds(gap_ms, run), f"{run} long, end_step long, reason string", "append", "eventTime")


STATE = ("step", "lateral", "heading", "speed", "target", "dt")


class Replay(StatefulProcessor):
    """Steering and throttle of each step, in order; rows wait until the watermark has passed them. A silent run's memory goes."""

    def __init__(self, law: ControlLaw, gap_ms: int, run: str) -> None:
        self.law, self.gap_ms, self.run = law, gap_ms, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "held binary")
        self.memory = handle.getValueState("memory", "seen binary, runs binary")

    def blob(self, rows: pd.DataFrame) -> bytes:
        return packed(pa.Table.from_pandas(rows, preserve_index=False))

    def remembered(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The last errors of each run, in order; and what it has smoothed and steered, by run."""
        if self.memory.exists():
            seen, runs = (unpacked(held).to_pandas() for held in self.memory.get())
            return seen, runs.set_index(self.run)
        blank = lambda *names: {c: pd.Series(dtype="int64" if c in (self.run, "last_due") else float) for c in names}
        return pd.DataFrame(blank(self.run, "lateral", "heading")), pd.DataFrame(blank(self.run, "a", "b", "last", "last_due")).set_index(self.run)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        timers = list(self.handle.listTimers())
        for batch in rows:
            held = batch[[self.run, *STATE]].astype({c: float for c in STATE if c != "step"})
            held.insert(0, "due", due(batch["ts"]))
            self.waiting.appendList([(self.blob(held),)])
            timers.append(int(held["due"].min()))
        only_timer(self.handle, min(timers))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, run = timerValues.getCurrentWatermarkInMs(), self.run
        held = [unpacked(r[0]).to_pandas() for r in self.waiting.get()]
        rows = pd.concat(held) if held else None
        seen, runs = self.remembered()
        later = None
        if rows is not None:
            ready, later = rows[rows["due"] <= now].sort_values([run, "due", "step"], kind="stable"), rows[rows["due"] > now]
            if len(ready):
                steer, seen, runs = self.replayed(ready, seen, runs)
                throttle = self.law.throttle(ready["speed"].to_numpy(), ready["target"].to_numpy())
                yield with_run(pd.DataFrame({run: ready[run].to_numpy(), "step": ready["step"].to_numpy(), "steer": steer, "throttle": throttle}), key, run)
        runs = runs[runs["last_due"] + self.gap_ms > now]
        seen = seen[seen[run].isin(runs.index)]
        timers = []
        if later is not None and len(later):
            self.waiting.put([(self.blob(later),)])
            timers.append(int(later["due"].min()))
        else:
            self.waiting.clear()
        if len(runs):
            self.memory.update((self.blob(seen), self.blob(runs.reset_index())))
            timers.append(int(runs["last_due"].min()) + self.gap_ms)
        else:
            self.memory.clear()
        if timers:
            only_timer(self.handle, min(timers))
        else:
            no_timer(self.handle)

    def replayed(self, ready: pd.DataFrame, seen: pd.DataFrame, runs: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame, pd.DataFrame]:
        """The steering of rows that are in order by run, and what is remembered after them. A stretch ends at a silence."""
        run, of, at = self.run, ready[self.run].to_numpy(), ready["due"].to_numpy()
        first = np.append(True, of[1:] != of[:-1])
        stretch = np.cumsum(first | np.append(True, np.diff(at) > self.gap_ms)) - 1
        n, heads = stretch[-1] + 1, stretch[first]
        before = runs.reindex(of[first])
        goes = (at[first] - before["last_due"] <= self.gap_ms).to_numpy()  # false where nothing is known
        known, smooth, last = np.zeros(n, bool), np.zeros((2, n)), np.zeros(n)
        known[heads] = goes
        for into, c in ((smooth[0], "a"), (smooth[1], "b"), (last, "last")):
            into[heads] = np.where(goes, before[c], 0.0)
        held = seen.merge(pd.DataFrame({run: of[first][goes], "stretch": heads[goes]}), on=run).assign(dt=0.0)
        both = pd.concat([held, ready.assign(stretch=stretch)[[run, "lateral", "heading", "dt", "stretch"]]]).sort_values("stretch", kind="stable")
        counts = np.bincount(both["stretch"], minlength=n)
        steer, smooth, last = self.law.replay(counts, *[both[c].to_numpy(float) for c in ("lateral", "heading", "dt")], np.bincount(held["stretch"].astype("int64"), minlength=n), known, smooth, last)
        end = np.append(of[1:] != of[:-1], True)
        ends = stretch[end]
        after = pd.DataFrame({"a": smooth[0][ends], "b": smooth[1][ends], "last": last[ends], "last_due": at[end]}, index=pd.Index(of[end], name=run))
        tail = both[both["stretch"].isin(ends)].groupby("stretch").tail(self.law.latency)[[run, "lateral", "heading"]]
        return steer, pd.concat([seen[~seen[run].isin(after.index)], tail]), pd.concat([runs[~runs.index.isin(after.index)], after])


def control_stream(states: DataFrame, law: ControlLaw, late: str, gap_ms: int, run: str = "run_id") -> DataFrame:
    """run, step, steer, throttle of a stream of states (run, step, ts, lateral, heading, speed, target, dt), as ``outcomes.replay_control`` has them.

    A run that was silent for more than ``gap_ms`` starts afresh.
    """
    rows = states.withWatermark("ts", late).select(*shared_out(run), "ts", *STATE)
    return rows.groupBy("share").transformWithStateInPandas(Replay(law, gap_ms, run), f"{run} long, step long, steer double, throttle double", "append", "eventTime")

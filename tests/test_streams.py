"""Streams against their batch twins: any cut into micro-batches, late rows, silent runs, restarts from a checkpoint."""

import datetime as dt
import random

import pytest

from rareflow.operators import outcomes, telemetry
from rareflow.operators.control import ControlLaw
from rareflow.streaming import episodes, live, runs

START = dt.datetime(2024, 1, 1)
FAR = dt.datetime(2024, 2, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


class Feed:
    """Micro-batches, each a restart from the checkpoint: a stream's input folder grows by a file and the stream runs until it has read it."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in/*")

    def push(self, rows, make, finish=runs.finish, *more):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.n}")
        self.n += 1
        return finish(make(self.stream()), *more, f"{self.folder}/out")


STEPS = "run_id long, step long, ts timestamp, xte double, elapsed double, done boolean, beyond_end boolean"


def step(run, k, xte=0.0, elapsed=None, done=False, road=False, ts=None):
    return (run, k, at(k) if ts is None else ts, xte, float(k if elapsed is None else elapsed), done, road)


def ends(stream):
    return episodes.episode_ends(stream, "10 seconds", 60_000, 2.0, 500.0)


def test_first_of_all_conditions_ends_a_run(spark, tmp_path):
    rows = [step(1, k, xte=3.0 if k >= 7 else 0.1) for k in range(12)]
    rows += [step(2, k, done=k == 5, xte=-2.5 if k == 9 else 0.0) for k in range(12)]
    rows += [step(3, k, road=k == 6, elapsed=501 if k == 6 else 1) for k in range(12)]
    rows += [step(4, k, road=k == 8) for k in range(12)] + [step(5, k) for k in range(12)] + [step(6, 3, xte=2.0, elapsed=500.0)]
    want = {1: (7, "lane"), 2: (5, "done"), 3: (6, "time"), 4: (8, "road"), 5: (11, "silent"), 6: (3, "silent")}
    batch = telemetry.episode_end(spark.createDataFrame(rows, STEPS), 2.0, 500.0)
    assert {r.run_id: (r.end_step, r.reason) for r in batch.collect()} == want
    feed = Feed(spark, tmp_path, STEPS)
    random.Random(1).shuffle(rows)
    feed.push(rows, ends)
    got = feed.push([step(99, 0, ts=FAR)], ends)  # the watermark passes all
    assert {r.run_id: (r.end_step, r.reason) for r in got.collect()} == want


def test_a_run_that_never_ends_is_closed_by_silence_alone(spark, tmp_path):
    feed = Feed(spark, tmp_path, STEPS)
    assert feed.push([step(1, k) for k in range(5)], ends).count() == 0
    assert feed.push([step(2, 60, xte=9.0)], ends).count() == 0  # 46 s after the run's last step by the watermark
    got = feed.push([step(3, 75)], ends)
    assert sorted((r.run_id, r.end_step, r.reason) for r in got.collect()) == [(1, 4, "silent"), (2, 60, "lane")]


def test_an_earlier_end_in_time_wins_and_a_late_one_drops(spark, tmp_path):
    feed = Feed(spark, tmp_path, STEPS)
    feed.push([step(1, 20, xte=5.0), step(2, 20, xte=5.0), step(1, 21, xte=5.0)], ends)  # watermark 11
    got = feed.push([step(1, 15, done=True), step(2, 9, done=True)], ends)  # the second one is too late
    assert got.count() == 0
    got = feed.push([step(1, 40, xte=5.0)], ends)  # a step after the end opens nothing
    got = feed.push([step(9, 0, ts=FAR)], ends)
    assert sorted((r.run_id, r.end_step, r.reason) for r in got.collect()) == [(1, 15, "done"), (2, 20, "lane")]


@pytest.mark.parametrize("seed", [1, 2])
def test_episodes_however_rows_are_cut(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [step(run, k, xte=r.choice([0.0, 0.0, 0.0, 2.5]), done=r.random() < 0.05, road=r.random() < 0.02) for run in range(12) for k in range(r.randint(1, 30))]
    want = {x.run_id: (x.end_step, x.reason) for x in telemetry.episode_end(spark.createDataFrame(rows, STEPS), 2.0, 500.0).collect()}
    rows.sort(key=lambda x: x[2] + dt.timedelta(seconds=r.uniform(0, 9)))  # out of order by less than the delay
    feed = Feed(spark, tmp_path, STEPS)
    for i in range(0, len(rows), 60):
        feed.push(rows[i : i + 60], ends)
    got = feed.push([step(99, 0, ts=FAR)], ends)
    assert sorted((x.run_id, x.end_step, x.reason) for x in got.collect()) == sorted((k, *v) for k, v in want.items())


def test_many_short_runs_share_a_state(spark, tmp_path):
    """The state of all runs is read and written a share at a time: at most SHARES keys and one for rows without a run."""
    rows = [step(run, run % 7, xte=9.0 if run % 3 == 0 else 0.0) for run in range(6000)] + [(None, 4, at(4), 0.0, 4.0, False, False)]
    feed = Feed(spark, tmp_path, STEPS)
    feed.push(rows, ends)
    progress = []
    finish = lambda out, where: (runs.finish(out, where), progress.append(spark.read.format("statestore").option("batchId", 0).option("stateVarName", "episodes").load(f"{where}/state").count()))[0]
    got = feed.push([step(9999, 0, ts=FAR)], ends, finish).collect()
    assert {(x.run_id, x.end_step, x.reason) for x in got} == {(run, run % 7, "lane" if run % 3 == 0 else "silent") for run in range(6000)} | {(None, 4, "silent")}
    assert len(got) == 6001 and progress[0] <= episodes.SHARES + 1


STATES = "run_id long, step long, ts timestamp, lateral double, heading double, speed double, target double, dt double"


@pytest.mark.parametrize("latency,tau,rate", [(0, 0.0, 4.0), (3, 0.2, 4.0), (2, 0.5, 0.0)])
def test_control_however_rows_are_cut(spark, tmp_path, latency, tau, rate):
    r = random.Random(latency)
    rows = [(run, k, at(k + run / 1000), r.uniform(-2, 2), r.uniform(-1, 1), r.uniform(0, 9), 8.0, r.choice([0.1, 0.05, 0.0, -1.0])) for run in range(5) for k in range(25)]
    law = ControlLaw(latency, tau, max_rate=rate)
    batch = outcomes.replay_control(spark.createDataFrame(rows, STATES), latency, tau, max_rate=rate)
    want = {(x.run_id, x.step): (x.steer, x.throttle) for x in batch.collect()}
    rows.sort(key=lambda x: x[2] + dt.timedelta(seconds=r.uniform(0, 9)))
    feed = Feed(spark, tmp_path, STATES)
    for i in range(0, len(rows), 50):
        feed.push(rows[i : i + 50], lambda s: episodes.control_stream(s, law, "10 seconds", 3_600_000))
    got = feed.push([(99, 0, FAR, 0.0, 0.0, 0.0, 0.0, 0.1)], lambda s: episodes.control_stream(s, law, "10 seconds", 3_600_000)).collect()
    assert len(got) == len(want)
    assert {(x.run_id, x.step): (x.steer, x.throttle) for x in got} == want


def test_control_of_many_runs_in_shares(spark, tmp_path):
    law, r = ControlLaw(latency=1, tau=0.3), random.Random(8)
    rows = [(run, k, at(k), r.uniform(-2, 2), r.uniform(-1, 1), 3.0, 8.0, 0.1) for run in (*range(3000), None) for k in range(1 + (run or 2) % 3)]
    want = {(x.run_id, x.step): (x.steer, x.throttle) for x in outcomes.replay_control(spark.createDataFrame(rows, STATES), 1, 0.3).collect()}
    make = lambda s: episodes.control_stream(s, law, "10 seconds", 3_600_000)
    feed, keys = Feed(spark, tmp_path, STATES), []
    count = lambda where: spark.read.format("statestore").option("batchId", 0).option("stateVarName", "waiting").load(f"{where}/state").select("key").distinct().count()
    finish = lambda out, where: (runs.finish(out, where), keys.append(count(where)))[0]
    feed.push(rows, make)
    got = feed.push([(99999, 0, FAR, 0.0, 0.0, 0.0, 0.0, 0.1)], make, finish).collect()
    assert {(x.run_id, x.step): (x.steer, x.throttle) for x in got} == want and len(got) == len(rows)
    assert keys[0] <= episodes.SHARES + 1


def test_a_silent_key_starts_afresh(spark, tmp_path):
    law = ControlLaw(latency=2, tau=0.3)
    once = [(1, k, at(k), 1.0 - k / 5, 0.2, 3.0, 8.0, 0.1) for k in range(6)]
    again = [(1, 100 + k, at(1000 + k), 1.0 - k / 5, 0.2, 3.0, 8.0, 0.1) for k in range(6)]
    feed = Feed(spark, tmp_path, STATES)
    make = lambda s: episodes.control_stream(s, law, "10 seconds", 60_000)
    feed.push(once, make)
    feed.push(again, make)
    got = {x.step: x.steer for x in feed.push([(99, 0, FAR, 0.0, 0.0, 0.0, 0.0, 0.1)], make).collect()}
    assert [got[k] for k in range(6)] == [got[100 + k] for k in range(6)] and len(set(got.values())) > 3


POINTS = "ts timestamp, user long, margin double"


@pytest.mark.parametrize("slide", [None, "10 seconds"])
def test_a_late_row_drops_and_one_in_time_counts(spark, tmp_path, slide):
    feed = Feed(spark, tmp_path, POINTS)
    make = lambda s: live.windowed_failure_rate(s, "ts", "20 seconds", slide, "30 seconds")
    feed.push([(at(5), 1, -1.0), (at(15), 1, 1.0), (at(100), 1, 1.0)], make)  # watermark 70
    feed.push([(at(12), 2, -1.0), (at(75), 2, -1.0), (at(85), 2, 1.0)], make)  # 12 is late
    rows = feed.push([(FAR, 9, 1.0)], make).select("win.start", "n_valid", "n_failures").collect()
    got = {int((x.start - START).total_seconds()): (x.n_valid, x.n_failures) for x in rows}
    if slide is None:
        assert got == {0: (2, 1), 60: (1, 1), 80: (1, 0), 100: (1, 0)}
    else:
        assert got == {-10: (1, 1), 0: (2, 1), 10: (1, 0), 60: (1, 1), 70: (2, 1), 80: (1, 0), 90: (1, 0), 100: (1, 0)}


def test_a_job_is_delivered_once_across_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ts timestamp, job_id string, margin double")
    make = lambda s: live.once_per_job(s, "ts", late="30 seconds")
    feed.push([(at(0), "a", 1.0), (at(1), "a", 1.0), (at(2), "b", 2.0)], make)
    got = feed.push([(at(5), "b", 2.0), (at(6), "c", 3.0)], make)
    assert sorted(x.job_id for x in got.collect()) == ["a", "b", "c"]
    feed.push([(at(500), "d", 0.0)], make)
    got = feed.push([(at(3), "e", 2.0)], make)  # later than the watermark
    assert sorted(x.job_id for x in got.collect()) == ["a", "b", "c", "d"]


def test_sessions_grow_across_batches_and_late_rows_drop(spark, tmp_path):
    feed = Feed(spark, tmp_path, POINTS)
    make = lambda s: live.sessions(s, "ts", "user", "10 seconds", "20 seconds")
    feed.push([(at(0), 1, 0.0), (at(8), 1, 0.0), (at(22), 1, 0.0)], make)  # watermark 2
    feed.push([(at(15), 1, 0.0), (at(60), 2, 0.0)], make)  # joins the two; watermark 40
    feed.push([(at(5), 3, 0.0)], make)  # late
    got = feed.push([(FAR, 9, 0.0)], make)
    assert sorted((x.user, int((x.session.start - START).total_seconds()), x.n) for x in got.collect()) == [(1, 0, 4), (2, 60, 1)]


def test_running_margin_in_update_mode_goes_on_after_a_restart(spark, tmp_path):
    r = random.Random(3)
    form = "run_id long, step long, xte double, steering double"
    rows = [(run, k, r.uniform(-2.4, 2.4), r.uniform(-1, 1)) for run in range(6) for k in range(20)]
    r.shuffle(rows)
    feed = Feed(spark, tmp_path, form)
    make = lambda s: live.running_margin(s).select("run_id", "n_steps", "margin")
    for i in range(0, len(rows), 45):
        got = feed.push(rows[i : i + 45], make, runs.finish_updates, ["run_id"])
        want = live.running_margin(spark.createDataFrame(rows[: i + 45], form))
        assert {x.run_id: (x.n_steps, x.margin) for x in got.collect()} == {x.run_id: (x.n_steps, pytest.approx(x.margin)) for x in want.collect()}

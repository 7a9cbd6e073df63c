"""Streams over ``events``, run until their input is used up; SQL gives what the last watermark has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outcomes, telemetry
from ..operators.control import ControlLaw
from ..sources import views
from ..streaming import episodes, live, runs
from .queries import WILSON, query, r6, tidy

LATE, LATE_MS, DAY_MS = "10 minutes", 600_000, 86_400_000
MAX_XTE, MAX_SECONDS = 2.4, 72_000.0
LAW = ControlLaw(latency=2, tau=0.2)

#: The watermark when all rows of one file have been seen.
MARK = f"mark AS (SELECT epoch_ms(max(ts)) - {LATE_MS} AS ms FROM events)"
#: Steps of a run that is a user's day; a step's number is its event's.
EPISODES = """ep AS (SELECT user_id * 100 + day(ts) AS run_id, event_id AS step, ts, least(3.0, greatest(-3.0, (value - 50) / 40)) AS xte, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS elapsed,
 event_type = 'purchase' AND event_id % 3 = 0 AS done, event_type = 'view' AND event_id % 11 = 0 AS beyond_end FROM events)"""
REASONS = f"""{EPISODES}, er AS (SELECT *, CASE WHEN elapsed > {MAX_SECONDS} THEN 'time' WHEN abs(xte) > {MAX_XTE} THEN 'lane' WHEN done THEN 'done' WHEN beyond_end THEN 'road' END AS reason FROM ep),
en AS (SELECT run_id, coalesce(min(step) FILTER (reason IS NOT NULL), max(step)) AS end_step, coalesce(arg_min(reason, step) FILTER (reason IS NOT NULL), 'silent') AS reason,
 coalesce(epoch_ms(arg_min(ts, step) FILTER (reason IS NOT NULL)) + 1, epoch_ms(max(ts)) + 1 + {DAY_MS}) AS due FROM er GROUP BY run_id)"""


def episode_steps(events: DataFrame) -> DataFrame:
    """Steps of runs from events, batch or stream: a user's day is a run."""
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    return events.select(
        (F.col("user_id") * 100 + F.dayofmonth(ts)).alias("run_id"), F.col("event_id").alias("step"), ts.alias("ts"),
        F.least(F.lit(3.0), F.greatest(F.lit(-3.0), (F.col("value") - 50) / 40)).alias("xte"), (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).alias("elapsed"),
        ((kind == "purchase") & (F.col("event_id") % 3 == 0)).alias("done"), ((kind == "view") & (F.col("event_id") % 11 == 0)).alias("beyond_end"),
    )


@query("k2_episode_end", f"WITH {REASONS} SELECT run_id, end_step, reason FROM en")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.episode_end(episode_steps(views.table(spark, sf_dir, "events")), MAX_XTE, MAX_SECONDS)


@query("k2_episode_stream", f"WITH {REASONS}, {MARK} SELECT run_id, end_step, reason FROM en, mark WHERE due <= ms")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = episode_steps(runs.opened(spark, sf_dir, "events"))
    return runs.finish(episodes.episode_ends(steps, LATE, DAY_MS, MAX_XTE, MAX_SECONDS), runs.place(spark))


#: The law by recursion over each run's steps, numbered from 1: errors of two steps ago, smoothed, clipped, limited by rate.
CONTROL = f"""cs AS (SELECT user_id AS run_id, event_id AS step, ts, row_number() OVER w AS i, least(3.0, greatest(-3.0, (value - 50) / 40)) AS e1, ((event_id * 37) % 201 - 100) / 300.0::DOUBLE AS e2,
 least(1.0, greatest(-1.0, 0.3 * (8.0 - (value % 60) / 3.6))) AS throttle FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
cl AS (SELECT *, coalesce(lag(e1, {LAW.latency}) OVER w, first_value(e1) OVER w) AS s1, coalesce(lag(e2, {LAW.latency}) OVER w, first_value(e2) OVER w) AS s2 FROM cs WINDOW w AS (PARTITION BY run_id ORDER BY i)),
cr AS (SELECT run_id, i, s1 AS m1, s2 AS m2, greatest(-0.4, least(0.4, greatest(-1.0, least(1.0, -0.35 * s1 - 0.8 * s2)))) AS steer FROM cl WHERE i = 1
 UNION ALL SELECT run_id, i, m1, m2, prev + greatest(-0.4, least(0.4, greatest(-1.0, least(1.0, -0.35 * m1 - 0.8 * m2)) - prev)) FROM
 (SELECT cl.run_id, cl.i, exp(-0.5) * m1 + (1 - exp(-0.5)) * s1 AS m1, exp(-0.5) * m2 + (1 - exp(-0.5)) * s2 AS m2, steer AS prev FROM cr JOIN cl ON cl.run_id = cr.run_id AND cl.i = cr.i + 1))"""
STEERED = "SELECT run_id, step, round(steer, 6) AS steer, round(throttle, 6) AS throttle FROM cr JOIN cs USING (run_id, i)"


def control_states(events: DataFrame) -> DataFrame:
    """States of runs from events, batch or stream: a user is a run."""
    xte = F.least(F.lit(3.0), F.greatest(F.lit(-3.0), (F.col("value") - 50) / 40))
    heading = ((F.col("event_id") * 37) % 201 - 100) / F.lit(300.0)
    return events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("ts").cast("timestamp").alias("ts"), xte.alias("lateral"), heading.alias("heading"),
        ((F.col("value") % 60) / 3.6).alias("speed"), F.lit(8.0).alias("target"), F.lit(0.1).alias("dt"),
    )


@query("k5_control_replay", f"WITH RECURSIVE {CONTROL} {STEERED}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = outcomes.replay_control(control_states(views.table(spark, sf_dir, "events")), LAW.latency, LAW.tau)
    return got.select("run_id", "step", r6("steer", "steer"), r6("throttle", "throttle"))


@query("k5_control_stream", f"WITH RECURSIVE {CONTROL}, {MARK} {STEERED}, mark WHERE epoch_ms(ts) + 1 <= ms")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = control_states(runs.opened(spark, sf_dir, "events"))
    got = runs.finish(episodes.control_stream(states, LAW, LATE, 365 * DAY_MS), runs.place(spark))
    return got.select("run_id", "step", r6("steer", "steer"), r6("throttle", "throttle"))


HOURS = """st AS (SELECT user_id AS run_id, hour(ts) AS step, least(3.0, greatest(-3.0, (value - 50) / 40)) AS xte, ((event_id * 37) % 201 - 100) / 100.0::DOUBLE AS steering FROM events),
m AS (SELECT run_id, count(*) AS n_steps, max(abs(xte)) AS mx, max(abs(steering)) AS ms, avg(abs(steering)) AS av, min(step) FILTER (abs(xte) > 1.75) AS fn FROM st GROUP BY run_id)"""


@query("k1_running_stream", f"""WITH {HOURS} SELECT run_id, n_steps, round(CASE WHEN n_steps >= 3 THEN 0.6 * (2.5 - mx) - 0.2 * least(1.0, greatest(0.0, (ms - av) / 0.4)) - 0.2 * ((n_steps - coalesce(fn, n_steps)) / n_steps::DOUBLE) END, 6) AS margin FROM m""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode: each run's last margin. A step is the hour of its event."""
    ev = runs.opened(spark, sf_dir, "events")
    steps = ev.select(F.col("user_id").alias("run_id"), F.hour("ts").alias("step"), F.least(F.lit(3.0), F.greatest(F.lit(-3.0), (F.col("value") - 50) / 40)).alias("xte"), (((F.col("event_id") * 37) % 201 - 100) / 100.0).alias("steering"))
    got = runs.finish_updates(live.running_margin(steps).select("run_id", "n_steps", "margin"), ["run_id"], runs.place(spark))
    return got.select("run_id", "n_steps", r6("margin", "margin"))


def windows_sql(length: str, slide: str, shifts: int) -> str:
    """Wilson rows of the windows that the watermark has closed."""
    rows = f"SELECT time_bucket(INTERVAL '{slide}', ts) - k * INTERVAL '{slide}' AS start, (50 - value) / 50 AS margin FROM events, range({shifts}) r(k)"
    per = "SELECT start, count(margin) AS n_valid, count(*) FILTER (margin < 0) AS n_failures FROM w GROUP BY start"
    rates = f"SELECT *, n_valid::DOUBLE AS n, n_failures / n_valid::DOUBLE AS p FROM ({per})"
    return f"""WITH w AS ({rows}), {MARK} SELECT start, n_valid, n_failures, round(p, 6) AS p, round({WILSON.format(sign='-')}, 6) AS p_lo, round({WILSON.format(sign='+')}, 6) AS p_hi FROM ({rates}), mark WHERE epoch_ms(start + INTERVAL '{length}') <= ms"""


def windowed(spark: SparkSession, sf_dir: str, length: str, slide: str | None) -> DataFrame:
    points = runs.opened(spark, sf_dir, "events").select("ts", ((50 - F.col("value")) / 50).alias("margin"))
    got = runs.finish(live.windowed_failure_rate(points, "ts", length, slide, LATE), runs.place(spark))
    return tidy(got.withColumn("start", F.col("win.start").cast("timestamp_ntz")), "start").select("start", "n_valid", "n_failures", "p", "p_lo", "p_hi")


@query("k3_windowed_stream", windows_sql("1 hour", "1 hour", 1))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(spark, sf_dir, "1 hour", None)


@query("k3_sliding_stream", windows_sql("6 hours", "2 hours", 3))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(spark, sf_dir, "6 hours", "2 hours")


@query("k4_once_stream", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = runs.opened(spark, sf_dir, "events").select("ts", "user_id", "event_type", F.concat_ws(":", "user_id", "event_type").alias("job_id"))
    return runs.finish(live.once_per_job(jobs, "ts").select("user_id", "event_type"), runs.place(spark))


@query("k6_session_stream", f"""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL '12 hours', true)::INT AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), {MARK},
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, start, n FROM (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, no), mark WHERE epoch_us(last + INTERVAL '12 hours') <= ms * 1000""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = runs.opened(spark, sf_dir, "events").select("ts", "user_id")
    got = runs.finish(live.sessions(events, "ts", "user_id", "12 hours", LATE), runs.place(spark))
    return got.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), "n")

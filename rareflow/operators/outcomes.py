"""Outcomes, padding, traces and derived data sets of runs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.odd import hash_uniform
from .control import ControlLaw

#: Groups into which runs are dealt for Python.
SHARES = 1024
#: Roads that one task turns into centrelines.
ROADS = 5_000
#: Lateral error beyond which a run has left the road (a fixed value).
MAX_XTE = 2.5


def drop_padding(steps: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """The steps before each run's ``run_length``; a run without a length keeps all of its steps."""
    return steps.join(runs.select(run, "run_length"), run, "left").where(F.col("run_length").isNull() | (F.col("step") < F.col("run_length"))).drop("run_length")


def valid_counts(steps: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Real steps of every run, at least 1, so that shares never divide by zero."""
    held = drop_padding(steps, runs, run).groupBy(run).agg(F.count("*").alias("n"))
    return runs.select(run).join(held, run, "left").select(run, F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("valid_count"))


def outcome(arrived: Column, finished: Column, out: Column, crashed: Column, last_xte: Column) -> Column:
    """Why an episode ended. The later of these wins: max_step, arrive_dest, road_finished, out_of_road, crash, and
    out_of_road again for a last point beyond the lane. Null flags count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(F.abs(last_xte) > MAX_XTE), "out_of_road").when(yes(crashed), "crash").when(yes(out), "out_of_road")
        .when(yes(finished), "road_finished").when(yes(arrived), "arrive_dest").otherwise("max_step")
    )


def forced_margin(margin: Column, outcome: Column, valid: Column, survival: Column, max_steps: int = 300) -> Column:
    """A valid run off the road or crashed has a negative margin, the lower the sooner it ended."""
    forced = -0.001 - (1.0 - survival / max(1, max_steps))
    return F.when(outcome.isin("out_of_road", "crash") & valid, F.least(F.coalesce(margin, forced), forced)).otherwise(margin)


def survival(steps: DataFrame, channels: list[str], run: str = "run_id") -> DataFrame:
    """Steps of each run in which any channel is not zero."""
    total = sum((F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in channels), F.lit(0.0))
    return steps.groupBy(run).agg(F.count_if(total > 0).alias("survival"))


def worst_trace(steps: DataFrame, margins: DataFrame, run: str = "run_id") -> DataFrame:
    """The steps of the run with the least margin (the smaller id of several); one run reaches the join."""
    worst = margins.where("margin is not null").orderBy("margin", run).limit(1).select(run)
    return steps.join(worst, run, "left_semi")


def state_actions(steps: DataFrame, runs: DataFrame, dt: float, run: str = "run_id") -> DataFrame:
    """Training rows of each step: velocity, distance left (never negative), time, and whether the brake is on.

    ``steps``: run, step, position, velocity; ``runs``: run, detection_dist, delay."""
    rows = steps.join(runs.select(run, "detection_dist", "delay"), run)
    time = F.col("step") * F.lit(dt)
    return rows.select(
        run, "step", "velocity", F.greatest(F.lit(0.0), F.col("detection_dist") - F.col("position")).alias("distance"), time.alias("time"),
        ((time >= F.col("delay")) & (F.col("velocity") > 0)).cast("double").alias("brake"))


def with_split(archives: list[DataFrame], ident: str, validation: float = 0.2, salt: int = 77) -> DataFrame:
    """The union of archives, each row marked train or validation by its id, the same on every run."""
    every = archives[0]
    for other in archives[1:]:
        every = every.unionByName(other)
    return every.withColumn("split", F.when(hash_uniform(F.col(ident), salt) < validation, "validation").otherwise("train"))


def trajectory_modes(steps: DataFrame, channels: list[str], length: int, share: float = 0.95, run: str = "run_id") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """POD of runs: (run, code), modes as rows, and the share of variance each explains.

    A run is a vector of ``length`` steps of each channel, missing steps being 0. Means and the matrix of centred
    products are sums over the cluster, of size (length x channels) squared; its eigenvectors are found on the driver.
    The fewest modes that explain ``share`` stay; each is turned so that its largest entry is positive.
    """
    width = length * len(channels)
    if width > 2000:
        raise ValueError(f"{width} columns; the product matrix is meant for 2000 at most")
    at = [F.max(F.when((F.col("step") == t), F.col(c))) for c in channels for t in range(length)]
    vectors = steps.where(F.col("step") < length).groupBy(run).agg(F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in at]).alias("v"))

    def products(batches):
        total, gram, n = np.zeros(width), np.zeros((width, width)), 0
        for rows in batches:
            x = np.array(rows["v"].tolist(), float).reshape(-1, width)
            total, gram, n = total + x.sum(axis=0), gram + x.T @ x, n + len(x)
        yield pd.DataFrame({"i": np.arange(width + 1), "row": [*gram.tolist(), [*total.tolist()]], "n": n})

    parts = vectors.select("v").mapInPandas(products, "i int, row array<double>, n long").where("n > 0")
    sums = parts.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(width)], F.sum("n").alias("n")).orderBy("i").collect()
    if not sums:
        return vectors.select(run, F.col("v").alias("code")), np.zeros((0, width)), np.zeros(0)
    matrix, n = np.array([[r[f"c{j}"] for j in range(width)] for r in sums]), sums[0]["n"]
    mean = matrix[width] / n
    values, columns = np.linalg.eigh(matrix[:width] / n - np.outer(mean, mean))
    values, modes = np.maximum(values[::-1], 0), columns.T[::-1]
    modes = modes * np.sign(modes[np.arange(width), np.abs(modes).argmax(axis=1)])[:, None]
    explained = values / (values.sum() or 1.0)
    keep = int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)
    modes, explained = modes[:keep], explained[:keep]
    centred = F.zip_with("v", F.lit(mean.tolist()), lambda x, m: x - m)
    dot = lambda mode: F.aggregate(F.zip_with(centred, F.lit(mode.tolist()), lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    return vectors.select(run, F.array(*[dot(m) for m in modes]).alias("code")), modes, explained


def replay_control(states: DataFrame, latency: int = 0, tau: float = 0.0, k_lat: float = 0.35, k_head: float = 0.8, k_throttle: float = 0.3,
                   max_rate: float = 4.0, reference_dt: float = 0.05, run: str = "run_id") -> DataFrame:
    """run, step, steer, throttle of the proportional control law over recorded states, without noise.

    ``states``: run, step, lateral, heading, speed, target, dt. The errors seen are those ``latency`` steps ago (the
    oldest there is, at first), smoothed with time constant ``tau``; steering is limited by rate. Runs are dealt into
    ``SHARES`` groups, since a call to Python for each run costs a millisecond; rows without a run are one run.
    """

    law = ControlLaw(latency, tau, k_lat, k_head, k_throttle, max_rate, reference_dt)
    share = F.when(F.col(run).isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(run), F.lit(SHARES)))

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([run, "step"], kind="stable")
        counts = np.unique(rows[run].to_numpy(), return_counts=True)[1]
        steer = law.replay(counts, *[rows[c].to_numpy(float) for c in ("lateral", "heading", "dt")])[0]
        throttle = law.throttle(rows["speed"].to_numpy(float), rows["target"].to_numpy(float))
        return pd.DataFrame({"share": rows["share"], run: rows[run], "step": rows["step"], "steer": steer, "throttle": throttle})

    held = states.select(share.alias("share"), F.coalesce(F.col(run), F.lit(0)).cast("long").alias(run), "step", "lateral", "heading", "speed", "target", "dt")
    got = held.groupBy("share").applyInPandas(replay, f"share long, {run} long, step int, steer double, throttle double")
    return got.select(F.when(F.col("share") >= 0, F.col(run)).alias(run), "step", "steer", "throttle")


def centreline(roads: DataFrame, angles: str = "angles", segment: str = "segment", points: int = 20, run: str = "run_id") -> DataFrame:
    """run, vertex, x, y of each road: cumulative turns of equal segments, joined by centripetal Catmull-Rom arcs.

    n angles (degrees) give n + 2 control nodes, the first a point ahead of the start that only sets the first tangent,
    and n - 1 arcs of ``points`` vertices; the vertex that two arcs share comes once. Roads are small and become many
    rows, so they are dealt to tasks by their number, not by the bytes that they are read from.
    """
    roads = roads.repartition(max(1, math.ceil(roads.count() / ROADS)))
    turn = F.transform(F.sequence(F.lit(1), F.size(angles)), lambda k: F.radians(F.aggregate(F.slice(F.col(angles), F.lit(1), k), F.lit(0.0), lambda a, x: a + x)))
    rows = roads.select(run, F.col(segment).cast("double").alias("len"), turn.alias("turn"))
    step = lambda f: F.transform("turn", lambda t: F.col("len") * f(t))
    rows = rows.withColumns({"dx": step(F.cos), "dy": step(F.sin)})
    along = lambda d, k: F.aggregate(F.slice(F.col(d), F.lit(1), k), F.lit(0.0), lambda a, x: a + x)
    ends = F.transform(F.sequence(F.lit(1), F.size("turn")), lambda k: F.struct(along("dx", k).alias("x"), along("dy", k).alias("y")))
    first = F.array(F.struct(F.col("len").alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    rows = rows.select(run, F.concat(first, ends).alias("node")).withColumn("arc", F.explode(F.sequence(F.lit(0), F.size("node") - 4)))
    node = {i: F.col("node")[F.col("arc") + i] for i in range(4)}
    rows = rows.select(run, "arc", *[node[i][c].alias(f"{c}{i}") for i in range(4) for c in "xy"])
    gap = lambda i: F.sqrt(F.hypot(F.col(f"x{i + 1}") - F.col(f"x{i}"), F.col(f"y{i + 1}") - F.col(f"y{i}")))
    rows = rows.withColumns({"t0": F.lit(0.0), "t1": gap(0)}).withColumn("t2", F.col("t1") + gap(1)).withColumn("t3", F.col("t2") + gap(2))
    rows = rows.withColumn("k", F.explode(F.sequence(F.when(F.col("arc") > 0, 1).otherwise(0), F.lit(points - 1))))
    rows = rows.withColumn("t", F.col("t1") + (F.col("t2") - F.col("t1")) * F.col("k") / (points - 1))

    def between(a: Column, b: Column, i: int, j: int) -> Column:
        lo, hi = F.col(f"t{i}"), F.col(f"t{j}")
        return (hi - F.col("t")) / (hi - lo) * a + (F.col("t") - lo) / (hi - lo) * b

    for c in "xy":
        p = [F.col(f"{c}{i}") for i in range(4)]
        a = [between(p[i], p[i + 1], i, i + 1) for i in range(3)]
        b = [between(a[i], a[i + 1], i, i + 2) for i in range(2)]
        rows = rows.withColumn(c, between(b[0], b[1], 1, 2))
    vertex = F.col("arc") * (points - 1) + F.col("k")
    return rows.select(run, vertex.alias("vertex"), "x", "y")


def run_arms(arms: dict, seeds: list[int]) -> DataFrame:
    """Evaluations of every arm and seed. An arm is a function of a seed that gives (point_id, theta, margin)."""
    every = None
    for label, arm in arms.items():
        for seed in seeds:
            cloud = arm(seed).select(F.lit(label).alias("arm"), F.lit(seed).alias("seed"), "point_id", "theta", F.nanvl("margin", F.lit(None).cast("double")).alias("margin"))
            every = cloud if every is None else every.unionByName(cloud)
    return every


def order_in_run(steps: DataFrame, order: list[str], run: str = "run_id") -> DataFrame:
    """Adds step numbers from 0 in each run."""
    return steps.withColumn("step", F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1)

"""Importance sampling, bootstrap and surrogate scores."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.odd import Axis, Scenario, axis_ppf, hash_uniform, log_density, normal_cdf, quick_ppf
from ..functions.ranges import discard, exact_quantiles, ready, stored


def defensive_weight(log_q: Column, log_f: Column, alpha: float) -> Column:
    """1 / (alpha + (1 - alpha) q / f): at most 1 / alpha."""
    return 1 / (alpha + (1 - alpha) * F.exp(log_q - log_f))


def weighted_failure(points: DataFrame, by: list[str]) -> DataFrame:
    """p = mean of fail * w over valid points, and Kish's effective sample size."""
    ok = points.where("margin is not null")
    return ok.groupBy(*by).agg(
        F.avg(F.when(F.col("margin") < 0, F.col("w")).otherwise(0.0)).alias("p"),
        F.coalesce(F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("ess"), F.count("*").alias("n"),
    )


def usable(n_final: Column, alpha: float, least: int = 30) -> Column:
    return F.floor(n_final * alpha) >= least


#: Chances of at most 0, 1, ... events of a Poisson law of mean 1; eleven events and more count as eleven.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(11)]


def resample_weights(ident: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """Poisson weights by inversion of a uniform that each (row, resample) draws from its number, as ``hash_uniform`` does."""
    i, p = (ident % 2147483647) * 4096 + rep, 2147483647
    one = (i * 48271 + seed * 69621 + 12345) % p
    two = (one * one + i) % p
    return np.searchsorted(POISSON, ((two * two + seed * 7919 + 1) % p) / p, side="right")


def poisson_bootstrap(points: DataFrame, value: str, ident: str = "point_id", resamples: int = 4000, seed: int = 1) -> DataFrame:
    """lo, hi: 2.5 and 97.5 percentiles of the mean over at most 4096 resamples. A row's weights hang on its id alone, so
    they are the same however rows are dealt; each task emits one row of sums for each resample."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, s = np.zeros(resamples), np.zeros(resamples)
        for rows in batches:
            ids, x = rows[ident].to_numpy(np.int64), rows[value].to_numpy(float)
            for rep in range(resamples):
                k = resample_weights(ids, rep, seed)
                w[rep] += k.sum()
                s[rep] += k @ x
        yield pd.DataFrame({"rep": np.arange(resamples), "w": w, "s": s})

    held = points.where(F.col(value).isNotNull()).select(ident, value)
    per = held.mapInPandas(sums, "rep long, w double, s double").groupBy("rep").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    return per.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))


def failure_probability(mu: Column, sigma: Column, threshold: float = 0.0) -> Column:
    return normal_cdf((threshold - mu) / F.greatest(sigma, F.lit(1e-9)))


def binary_entropy(p: Column) -> Column:
    return -(p * F.log(p + 1e-9) + (1 - p) * F.log(1 - p + 1e-9))


def expected_improvement(mu: Column, sigma: Column, best: Column | float, xi: float = 0.01) -> Column:
    s = F.greatest(sigma, F.lit(1e-12))
    gain = best - mu - xi
    z = gain / s
    return gain * normal_cdf(z) + s * F.exp(-z * z / 2) / 2.5066282746310002


def cross_entropy_step(points: DataFrame, dims: int, rho: float, threshold: float, log_f: Column, log_q: Column) -> dict:
    """One descent step over sampled points (theta, margin): gamma and the elite's weighted moments for each axis.

    Weights are f / q, taken relative to the largest so that nothing overflows; state is 2 numbers an axis.
    """
    valid = points.where("margin is not null").withColumn("lw", log_f - log_q)
    bound = exact_quantiles(valid, F.col("margin"), {"gamma": rho}, []).first()
    if bound is None:
        return {"gamma": None, "n_elite": 0}
    gamma = max(bound["gamma"], threshold)
    elite = valid.where(F.col("margin") <= gamma)
    top = elite.agg(F.max("lw")).first()[0]
    w = F.exp(F.col("lw") - (top or 0.0))
    aggs = [F.count("*").alias("n"), F.sum(w).alias("w")]
    for i in range(dims):
        aggs += [F.sum(w * F.col("theta")[i]).alias(f"x{i}"), F.sum(w * F.col("theta")[i] * F.col("theta")[i]).alias(f"xx{i}")]
    r = elite.agg(*aggs).first()
    loc = [r[f"x{i}"] / r["w"] for i in range(dims)] if r["n"] else []
    scale = [max(0.0, r[f"xx{i}"] / r["w"] - m * m) ** 0.5 for i, m in enumerate(loc)]
    return {"gamma": gamma, "n_elite": r["n"], "loc": loc, "scale": scale}


def cross_entropy_search(ids: DataFrame, scenario: Scenario, margin: Column, per_round: int, final: int, rho: float = 0.1, alpha: float = 0.1,
                         rounds: int = 30, salt: int = 1, ident: str = "point_id") -> tuple[DataFrame, list[dict]]:
    """Rare-event probability by cross entropy: (points of the last mixture with w and margin, history of the proposals).

    ``ids`` gives the row ids draws are made from, one set of draws a round; ``margin`` is a Column of theta. Each round
    samples a truncated normal on the box, moves to the weighted moments of its elite, and stops when the elite's bound
    has come to the threshold, or too few points are valid or elite. The last sample is a defensive mixture: a share
    alpha from the operational distribution, the rest from the proposal. State between rounds is two numbers an axis.
    """
    spark, dims = ids.sparkSession, len(scenario.axes)
    ready(spark)
    wide = [a.upper - a.lower for a in scenario.axes]
    proposal = Scenario(tuple(Axis(a.name, a.lower, a.upper, "truncnorm", (a.lower + a.upper) / 2, 0.5 * w) for a, w in zip(scenario.axes, wide)), scenario.threshold)
    history: list[dict] = []

    def drawn(source: Scenario, n: int, turn: int, after: int = 0) -> DataFrame:
        rows = ids.where((F.col(ident) >= after) & (F.col(ident) < after + n)).select(F.col(ident).alias("point_id"))
        u = [hash_uniform(F.col("point_id"), salt + turn * dims + j) for j in range(dims)]
        return rows.select("point_id", F.array(*[axis_ppf(a, x, quick_ppf()) for a, x in zip(source.axes, u)]).alias("theta"))

    for turn in range(rounds):
        points = stored(drawn(proposal, per_round, turn).select("theta", margin.alias("margin")))
        step = cross_entropy_step(points, dims, rho, scenario.threshold, log_density(scenario, F.col("theta")), log_density(proposal, F.col("theta")))
        discard(points)
        history.append(step)
        if step["gamma"] is None or step["n_elite"] < 2:
            break
        moved = [Axis(a.name, a.lower, a.upper, "truncnorm", min(a.upper, max(a.lower, m)), max(sd, 0.03 * w)) for a, m, sd, w in zip(scenario.axes, step["loc"], step["scale"], wide)]
        proposal = Scenario(tuple(moved), scenario.threshold)
        if step["gamma"] <= scenario.threshold:
            break
    n_defensive = math.floor(alpha * final)
    last = drawn(scenario, n_defensive, rounds).unionByName(drawn(proposal, final - n_defensive, rounds, n_defensive))
    weight = defensive_weight(log_density(proposal, F.col("theta")), log_density(scenario, F.col("theta")), alpha)
    return last.withColumn("margin", margin).withColumn("w", weight), history

"""A given Gaussian process as a surrogate: scores for large pools, integrated failure probability, diverse batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .importance import failure_probability
from .regions import distance

#: A training set is factorised on the driver and sent to every task, so its size is checked.
MOST_POINTS = 2000
#: Pool rows that meet the training set at a time inside a task.
ROWS = 4096


@dataclass(frozen=True)
class Surrogate:
    """Squared-exponential process with one length-scale an axis, over values brought to mean 0 and deviation 1."""

    points: np.ndarray
    lengths: np.ndarray
    amplitude: float
    noise: float
    centre: float
    spread: float
    factor: np.ndarray
    weights: np.ndarray

    @classmethod
    def given(cls, points: np.ndarray, values: np.ndarray, lengths: np.ndarray, amplitude: float = 1.0, noise: float = 0.1) -> Surrogate:
        if len(points) > MOST_POINTS:
            raise ValueError(f"{len(points)} training points, {MOST_POINTS} at most")
        centre, spread = (float(values.mean()), float(values.std()) or 1.0) if len(values) else (0.0, 1.0)
        scaled = points / lengths
        factor = np.linalg.cholesky(_kernel(scaled, scaled, amplitude) + (noise + 1e-8) * np.eye(len(points)))
        weights = np.linalg.solve(factor.T, np.linalg.solve(factor, (values - centre) / spread))
        return cls(scaled, lengths, amplitude, noise, centre, spread, factor, weights)

    def predict(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of an observation at each row of ``u``."""
        k = _kernel(u / self.lengths, self.points, self.amplitude)
        var = self.amplitude + self.noise - (np.linalg.solve(self.factor, k.T) ** 2).sum(axis=0)
        return self.centre + self.spread * (k @ self.weights), self.spread * np.sqrt(np.maximum(var, 0.0))


def _kernel(a: np.ndarray, b: np.ndarray, amplitude: float) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return amplitude * np.exp(-0.5 * np.maximum(square, 0.0))


def score_pool(pool: DataFrame, model: Surrogate) -> DataFrame:
    """(point_id, u) with mu and sigma added: one narrow pass; a null or unfinished u gets nulls."""
    shared = pool.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        dims = len(model.lengths)
        for rows in batches:
            for at in range(0, len(rows), ROWS):
                part = rows.iloc[at : at + ROWS].copy()
                u = np.array([x if x is not None and len(x) == dims else [np.nan] * dims for x in part["u"]], float).reshape(-1, dims)
                part["mu"], part["sigma"] = model.predict(u)
                yield part

    nan = float("nan")
    scored = pool.select("point_id", "u").mapInPandas(run, "point_id long, u array<double>, mu double, sigma double")
    return scored.withColumns({c: F.when(F.col(c) != nan, F.col(c)) for c in ("mu", "sigma")})


def integrated_probability(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """p, its normal 95% interval clipped to [0, 1], and n, over draws from the operational distribution."""
    p = F.col("p")
    half = 1.96 * F.col("sd") / F.sqrt("n")
    got = scored.select(failure_probability(F.col("mu"), F.col("sigma"), threshold).alias("x")).agg(F.avg("x").alias("p"), F.stddev_pop("x").alias("sd"), F.count("x").alias("n"))
    return got.select("n", "p", F.greatest(F.lit(0.0), p - half).alias("p_lo"), F.least(F.lit(1.0), p + half).alias("p_hi"))


def axis_importance(lengths: DataFrame, top: int = 5) -> DataFrame:
    """(name, length) to the ``top`` shares of inverse length-scales. One row an axis, so the window is small."""
    inverse = 1 / F.greatest(F.col("length"), F.lit(1e-9))
    shares = lengths.select("name", inverse.alias("inverse")).withColumn("importance", F.col("inverse") / F.sum("inverse").over(Window.partitionBy()))
    return shares.select("name", "importance").orderBy(F.desc("importance"), "name").limit(top)


def diverse_batch(scored: DataFrame, k: int, apart: float) -> DataFrame:
    """(rank, point_id, u, score): best first, each at least ``apart`` from those before; filled up by score when short.

    Takes (point_id, u, score). Each of at most k passes takes the best point left and sets aside what lies near it,
    so only k points reach the driver. Ties go to the smallest id; rows without a score or place are left out.
    """
    left = scored.where("score is not null and u is not null").select("point_id", "u", "score").checkpoint()
    best = F.max_by(F.struct("point_id", "u", "score"), F.struct("score", -F.col("point_id"))).alias("best")
    taken, far = [], left
    while len(taken) < k and (row := far.agg(best).first()["best"]) is not None:
        taken.append(row)
        far = far.where(distance(F.col("u"), F.array(*map(F.lit, row["u"]))) >= apart).where(F.col("point_id") != row["point_id"])
    if len(taken) < k:
        rest = left.where(~F.col("point_id").isin([r["point_id"] for r in taken])).orderBy(F.desc("score"), "point_id").limit(k - len(taken))
        taken += rest.collect()
    rows = [(i, r["point_id"], list(r["u"]), r["score"]) for i, r in enumerate(taken)]
    return scored.sparkSession.createDataFrame(rows, "rank int, point_id long, u array<double>, score double")

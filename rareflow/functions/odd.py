"""The operational distribution of a scenario space: independent marginals as Column expressions.

Normal CDF and inverse come from published rational approximations, because Spark SQL has neither; normalisers of the
log-density are scalars computed on the driver with math.erf.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """One parameter: bounds and family ('uniform' or 'truncnorm' with mode mu and scale sigma)."""

    name: str
    lower: float
    upper: float
    family: str = "uniform"
    mu: float = 0.0
    sigma: float = 0.0

    def bounded(self) -> "Axis":
        """A truncated normal without a scale or a range falls back to a uniform of positive width."""
        if self.family == "truncnorm" and self.sigma > 0 and self.upper > self.lower:
            return self
        return Axis(self.name, self.lower, max(self.upper, self.lower + 1e-9))

    def cdf_scalar(self, x: float) -> float:
        a = self.bounded()
        if a.family == "uniform":
            return min(1.0, max(0.0, (x - a.lower) / (a.upper - a.lower)))
        lo, hi = _phi((a.lower - a.mu) / a.sigma), _phi((a.upper - a.mu) / a.sigma)
        return min(1.0, max(0.0, (_phi((x - a.mu) / a.sigma) - lo) / (hi - lo)))


@dataclass(frozen=True)
class Scenario:
    """Contract of a scenario: its axes and the failure threshold of the margin."""

    axes: tuple[Axis, ...]
    threshold: float = 0.0

    @property
    def lower(self) -> list[float]:
        return [a.lower for a in self.axes]

    @property
    def upper(self) -> list[float]:
        return [a.upper for a in self.axes]


def _phi(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def angle_axis(name: str, lower: float, upper: float) -> Axis:
    return Axis(name, lower, upper, "truncnorm", lower, 0.5 * (upper - lower))


def speed_axis(name: str, lower: float, upper: float) -> Axis:
    return Axis(name, lower, upper, "truncnorm", lower + 0.4 * (upper - lower), 0.3 * (upper - lower))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


#: Published coefficients (fixed values): Hart's CDF as given by West, Acklam's inverse.
CDF_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_LOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
MIDDLE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_LOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
EDGE_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
EDGE_LOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def normal_cdf(z: Column) -> Column:
    """Hart's rational approximation as given by West (double precision)."""
    return bound(z, _normal_cdf)


def _normal_cdf(z: Column) -> Column:
    a = F.abs(z)
    top = F.lit(0.0)
    for c in CDF_TOP:
        top = top * a + c
    low = F.lit(0.0)
    for c in CDF_LOW:
        low = low * a + c
    far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    tail = F.exp(-a * a / 2) * F.when(a < 7.07106781186547, top / low).otherwise(1 / (far * math.sqrt(2 * math.pi)))
    tail = F.when(a > 37, 0.0).otherwise(tail)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normal_ppf(p: Column) -> Column:
    """Acklam's rational approximation with one Halley step, relative error about 1e-15 in the middle."""
    def poly(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(0.0)
        for k in coefficients:
            out = out * x + k
        return out

    def start(p: Column) -> Column:
        q = p - 0.5
        middle = bound(q * q, lambda r: poly(MIDDLE_TOP, r) / poly(MIDDLE_LOW, r)) * q
        edge = bound(F.sqrt(-2 * F.log(F.least(p, 1 - p))), lambda low: poly(EDGE_TOP, low) / poly(EDGE_LOW, low))
        return F.when(F.abs(q) <= 0.47575, middle).when(q < 0, edge).otherwise(-edge)

    def halley(x: Column, p: Column) -> Column:
        u = (normal_cdf(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
        return bound(u, lambda u: x - u / (1 + x * u / 2))

    return bound(p, lambda p: bound(start(p), lambda x: halley(x, p)))


def normal_ppf_rows(p: pa.Array) -> pa.Array:
    """``normal_ppf`` of a batch of rows, by the same formulas."""
    p = p.to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(all="ignore"):
        q = p - 0.5
        low = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
        edge = np.polyval(EDGE_TOP, low) / np.polyval(EDGE_LOW, low)
        x = np.where(np.abs(q) <= 0.47575, np.polyval(MIDDLE_TOP, q * q) / np.polyval(MIDDLE_LOW, q * q) * q, np.where(q < 0, edge, -edge))
        a = np.abs(x)
        far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
        tail = np.exp(-a * a / 2) * np.where(a < 7.07106781186547, np.polyval(CDF_TOP, a) / np.polyval(CDF_LOW, a), 1 / (far * math.sqrt(2 * math.pi)))
        tail = np.where(a > 37, 0.0, tail)
        u = (np.where(x > 0, 1 - tail, tail) - p) * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
        return pa.array(x - u / (1 + x * u / 2), mask=np.isnan(p))


def quick_ppf() -> Callable[[Column], Column]:
    return F.arrow_udf(normal_ppf_rows, "double")


def axis_cdf(axis: Axis, x: Column) -> Column:
    a = axis.bounded()
    if a.family == "uniform":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - a.lower) / (a.upper - a.lower)))
    lo, hi = _phi((a.lower - a.mu) / a.sigma), _phi((a.upper - a.mu) / a.sigma)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (normal_cdf((x - a.mu) / a.sigma) - lo) / (hi - lo)))


def axis_ppf(axis: Axis, u: Column, normal: Callable[[Column], Column] = normal_ppf) -> Column:
    """Inverse CDF; u is clipped to [1e-12, 1 - 1e-12]. For the draws of many rows ``normal`` may be ``quick_ppf()``, as
    Spark interprets the lambdas of ``normal_ppf``; the two differ in the last places only."""
    a, u = axis.bounded(), F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), u))
    if a.family == "uniform":
        return a.lower + u * (a.upper - a.lower)
    lo, hi = _phi((a.lower - a.mu) / a.sigma), _phi((a.upper - a.mu) / a.sigma)
    return F.least(F.lit(a.upper), F.greatest(F.lit(a.lower), a.mu + a.sigma * normal(lo + u * (hi - lo))))


def log_density(scenario: Scenario, theta: Column) -> Column:
    """Sum of the axes' log densities; -inf outside the box; a theta of another dimension is an error."""
    total = F.lit(0.0)
    inside = F.lit(True)
    for i, axis in enumerate(scenario.axes):
        a, x = axis.bounded(), theta[i]
        inside = inside & (x >= a.lower) & (x <= a.upper)
        if a.family == "uniform":
            total = total - math.log(a.upper - a.lower)
        else:
            mass = _phi((a.upper - a.mu) / a.sigma) - _phi((a.lower - a.mu) / a.sigma)
            z = (x - a.mu) / a.sigma
            total = total - z * z / 2 - math.log(a.sigma * math.sqrt(2 * math.pi) * mass)
    n = len(scenario.axes)
    value = F.when(inside, total).otherwise(F.lit(float("-inf")))
    return F.when(F.size(theta) != n, F.raise_error(F.lit(f"theta must have {n} entries")).cast("double")).otherwise(value)


def hash_uniform(ident: Column, salt: int) -> Column:
    """A reproducible uniform in [0, 1) from a BIGINT id; one salt for each axis."""
    p = F.lit(2147483647).cast("long")
    i = ident.cast("long")
    v1 = (i * 48271 + salt * 69621 + 12345) % p
    v2 = (v1 * v1 + i) % p
    return ((v2 * v2 + salt * 7919 + 1) % p) / p

"""The proportional control law over recorded states, a row at a time, with a memory that can be carried on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def clip(x: float, most: float) -> float:
    """x within plus and minus ``most``; what is not a number stays so."""
    return -most if x < -most else most if x > most else x


#: Below so many runs that go on, each is replayed by itself.
FEW = 8


def clipped(x: np.ndarray, most: np.ndarray | float) -> np.ndarray:
    return np.where(x < -most, -most, np.where(x > most, most, x))


@dataclass(frozen=True)
class ControlLaw:
    """``latency``: steps by which the errors seen are old. ``tau``: time constant of their smoothing (0: none). ``max_rate``: of
    steering, for each second (0: none). ``reference_dt`` stands for a missing or non-positive time step."""

    latency: int = 0
    tau: float = 0.0
    k_lat: float = 0.35
    k_head: float = 0.8
    k_throttle: float = 0.3
    max_rate: float = 4.0
    reference_dt: float = 0.05

    def throttle(self, speed: np.ndarray, target: np.ndarray) -> np.ndarray:
        return np.clip(self.k_throttle * (target - speed), -1, 1)

    def replay(self, counts: np.ndarray, lateral: np.ndarray, heading: np.ndarray, dt: np.ndarray, old: np.ndarray | None = None,
               known: np.ndarray | None = None, smooth: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``steer`` of whole runs side by side: rows in order, one run after another, ``counts`` rows of each.

        Runs may go on: their first ``old`` rows are remembered ones, which are only seen; ``smooth`` and ``last`` are what
        was smoothed and steered before, where ``known``. Returns the steering of the other rows, and these two at the end.
        """
        n = len(counts)
        old = np.zeros(n, "int64") if old is None else old
        known = np.zeros(n, bool) if known is None else known.copy()
        smooth, last = np.zeros((2, n)) if smooth is None else smooth.copy(), np.zeros(n) if last is None else last.copy()
        first, dt = np.repeat(np.cumsum(counts) - counts, counts), np.where(dt > 0, dt, self.reference_dt)
        place = np.arange(len(lateral)) - first
        new = place >= np.repeat(old, counts)
        seen = (first + np.maximum(0, place - self.latency))[new]
        errors, dt, counts = (lateral[seen], heading[seen]), dt[new], counts - old
        keep, most = np.exp(-dt / self.tau) if self.tau > 0 else np.zeros(len(dt)), self.max_rate * dt
        starts, steer, order = np.cumsum(counts) - counts, np.empty(len(dt)), np.argsort(-counts, kind="stable")
        for k in range(int(counts.max(initial=0))):
            runs = order[: np.searchsorted(-counts[order], -k)]  # those of more than k rows
            if len(runs) < FEW:
                for r in runs:
                    at = slice(starts[r] + k, starts[r] + counts[r])
                    steer[at], smooth[:, r] = self.rest(bool(known[r]), smooth[:, r].tolist(), float(last[r]), *[x[at].tolist() for x in (*errors, keep, most)])
                    last[r] = steer[at.stop - 1]
                break
            at = starts[runs] + k
            now = [e[at] for e in errors]
            if self.tau > 0:
                now = [np.where(known[runs], keep[at] * m[runs] + (1 - keep[at]) * e, e) for m, e in zip(smooth, now)]
            smooth[0, runs], smooth[1, runs] = now
            known[runs] = True
            wish = clipped(-self.k_lat * now[0] - self.k_head * now[1], 1.0)
            if self.max_rate > 0:
                wish = last[runs] + clipped(wish - last[runs], most[at])
            last[runs] = steer[at] = wish
        return steer, smooth, last

    def rest(self, known: bool, smooth: list[float], last: float, lateral: list[float], heading: list[float], keep: list[float], most: list[float]) -> tuple[list[float], list[float]]:
        """The steps of one run, and its smoothed pair at the end."""
        out, (a, b) = [], smooth
        for x, y, w, m in zip(lateral, heading, keep, most, strict=True):
            a, b = (w * a + (1 - w) * x, w * b + (1 - w) * y) if self.tau > 0 and known else (x, y)
            known, wish = True, clip(-self.k_lat * a - self.k_head * b, 1.0)
            last = last + clip(wish - last, m) if self.max_rate > 0 else wish
            out.append(last)
        return out, [a, b]

    def steer(self, memory: Memory, lateral: float, heading: float, dt: float) -> float:
        """One step; ``memory`` moves on."""
        dt = dt if dt > 0 else self.reference_dt  # not a number is not positive
        memory.seen.append((lateral, heading))
        del memory.seen[: -self.latency - 1]
        error = memory.seen[0]  # the oldest there is, at first
        if self.tau > 0:
            keep = np.exp(-dt / self.tau)
            error = error if memory.smooth is None else tuple(keep * m + (1 - keep) * e for m, e in zip(memory.smooth, error, strict=True))
            memory.smooth = error
        wish = clip(-self.k_lat * error[0] - self.k_head * error[1], 1.0)
        if self.max_rate > 0:
            wish = memory.last + clip(wish - memory.last, self.max_rate * dt)
        memory.last = wish
        return wish


@dataclass
class Memory:
    """What the law remembers of a run: the last pairs of errors, the smoothed pair, the last steering."""

    seen: list[tuple[float, float]]
    smooth: tuple[float, float] | None
    last: float

    @classmethod
    def fresh(cls) -> Memory:
        return cls([], None, 0.0)

"""How many tables the customers of a dish fill, drawn given all other dishes.

In a restaurant with discount d and concentration theta, whose other dishes fill T
tables, the tables t of a dish with c customers and base probability p have the law

    P(t)  ~  S(c, t) * p^t * (theta + d T)(theta + d (T + 1)) ... (theta + d (T + t - 1))

with S the generalised Stirling numbers, S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t).
It is the sum over all seatings of the dish's customers, so a draw is a Gibbs step that
moves all of them at once, at any count. S comes from the recurrence for few customers.
For many it is c! / (t! d^t) times the chance that t sizes, independent and Sibuya
distributed, add up to c: by the saddle point, corrected as at 512 customers for the
same t / c^d, or by the one size that makes up nearly all where t is small beside c^d.
The forms agree to within a few hundredths (``tests/llm/test_pitman_yor.py``).
"""

from __future__ import annotations

import math

import numpy as np

#: Customers up to which the recurrence is used, and those whose row corrects the saddle point.
EXACT, FIXED = 64, 512
#: Points at which the law of many customers is looked at, over all t and then where its mass is.
COARSE, FINE = 32, 48


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers, by Stirling's series after a shift."""
    x = np.asarray(x, float)
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    z = x + 8
    s = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s / 1680))) / z - np.log(product)


def log_stirling(d: float, top: int) -> np.ndarray:
    """log S(c, t) of all counts up to ``top``."""
    out = np.full((top + 1, top + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, top):
        t = np.arange(1, c + 2)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], np.log(np.maximum(c - d * t, 1e-300)) + out[c, 1 : c + 2])
    return out


class Law:
    """Draws of table counts at one discount."""

    def __init__(self, discount: float):
        self.d = d = discount
        exact = log_stirling(d, FIXED)
        self.small = exact[: EXACT + 1, : EXACT + 1]
        # saddle points of t sizes that add up to ratio * t
        self.ratio = np.concatenate([np.geomspace(1e-10, 0.01, 2000, endpoint=False), np.linspace(0.01, math.log(1e6), 20_000)])
        low, high = np.full(len(self.ratio), -200.0), np.full(len(self.ratio), -1e-12)
        for _ in range(80):
            y = (low + high) / 2  # log(1 - x)
            over = math.log(d) + np.log(-np.expm1(y)) + (d - 1) * y - np.log(-np.expm1(d * y)) > self.ratio
            low, high = np.where(over, y, low), np.where(over, high, y)
        x, f, k = -np.expm1(y), -np.expm1(d * y), np.exp(self.ratio)
        self.rate = np.log(f) - k * np.log1p(-np.exp(y))
        self.width = np.log(k + np.exp(np.log(x * x * d * (1 - d) / f) + (d - 2) * y) - k * k)
        t = np.arange(1, FIXED * 15 // 16 + 1.0)
        self.scale = np.log(t / FIXED**d)
        self.fix = exact[FIXED, 1 : len(t) + 1] - self._saddle(np.full(len(t), float(FIXED)), t)

    def _saddle(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """By the saddle point, with Stirling's error of the customers who open no table taken out; 0 where all do."""
        ratio, more = np.log(c / t), np.maximum(c - t, 1.0)
        error = log_gamma(more + 1) - 0.5 * np.log(2 * math.pi * more) - more * np.log(more) + more
        out = log_gamma(c + 1) - log_gamma(t + 1) + t * (np.interp(ratio, self.ratio, self.rate) - math.log(self.d)) - 0.5 * (np.log(2 * math.pi * t) + np.interp(ratio, self.ratio, self.width)) - error
        return np.where(c - t < 0.5, 0.0, out)

    def log_s(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log S(c, t) for many customers."""
        scale = np.log(t) - self.d * np.log(c)
        few = math.log(self.d) - float(log_gamma(1 - self.d)) + log_gamma(c - self.d) - log_gamma(t) - t * math.log(self.d)
        return np.where(scale < self.scale[0], few, self._saddle(c, t) + np.interp(scale, self.scale, self.fix, right=0.0))

    def draw(self, count: np.ndarray, others: np.ndarray, base: np.ndarray, rng) -> np.ndarray:
        """Tables of each dish. ``others``: tables of the restaurant's other dishes plus theta / d; ``base``: p."""
        out = np.minimum(count, 1)
        mass = np.log(self.d * base)
        order = np.argsort(count, kind="stable")
        edge = np.searchsorted(count[order], np.arange(2, EXACT + 2)).tolist()
        for c, a, b in zip(range(2, EXACT + 1), edge[:-1], edge[1:], strict=True):
            for own in np.split(order[a:b], range(1_000_000 // c, b - a, 1_000_000 // c)):
                t = np.arange(1, c + 1)
                weight = self.small[c, 1 : c + 1] + t * mass[own, None] + np.log(others[own, None] + (t - 1)).cumsum(axis=1)
                out[own] = 1 + _pick(weight, rng)
        for own in np.split(order[edge[-1] :], range(20_000, len(order) - edge[-1], 20_000)):
            if len(own):
                out[own] = self._draw_many(count[own].astype(float)[:, None], others[own, None], mass[own, None], rng)
        return out

    def _draw_many(self, c, others, mass, rng) -> np.ndarray:
        def weight(t):
            return np.where(t <= c, self.log_s(c, np.minimum(t, c)) + t * mass + log_gamma(others + t), -np.inf)

        at = c ** np.linspace(0, 1, COARSE)
        seen = weight(at)
        near = seen > seen.max(axis=1, keepdims=True) - 20
        rows = np.arange(len(c))
        low = np.floor(at[rows, np.maximum(near.argmax(axis=1) - 1, 0)])[:, None]
        high = np.ceil(at[rows, np.minimum(COARSE - near[:, ::-1].argmax(axis=1), COARSE - 1)])[:, None]
        for _ in range(2):  # once more, closer, where the coarse points were far apart
            step = np.maximum(1, np.ceil((high - low) / (FINE - 1)))
            at = low + step * np.arange(FINE)
            seen = weight(at)
            near = seen > seen.max(axis=1, keepdims=True) - 20
            low = at[rows, np.maximum(near.argmax(axis=1) - 1, 0)][:, None]
            high = np.minimum(at[rows, np.minimum(FINE - near[:, ::-1].argmax(axis=1), FINE - 1)][:, None], c)
        got = at[rows, _pick(seen, rng)]
        step = step[:, 0]
        return np.clip(got + np.rint((rng.random(len(got)) - 0.5) * step), 1, c[:, 0]).astype(np.int64)


def _pick(weight: np.ndarray, rng) -> np.ndarray:
    """A column of each row, with chances as exp(weight)."""
    cum = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
    return (cum > (rng.random(len(cum)) * cum[:, -1])[:, None]).argmax(axis=1)

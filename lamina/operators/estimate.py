"""Estimation of the Dirichlet-multinomial prior: limited-memory BFGS over aggregates, and its alternation with segmentation."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.dcm import digamma_rise, rising
from lamina.session import materialize

#: The slope may keep at most this share (curvature), and the value must fall by this share of what the slope promises (decrease).
CURVATURE, DECREASE = 0.9, 1e-4
#: A step grows by this factor at most where a cubic says how far, else by 4.
FARTHEST = 1_000
#: An interval of this width, relative, is a point.
NARROWEST = 1e-14
#: A sum's value is known to some 1e-16 of its size, so near a minimum it stands still where the slope is about the root of that.
TELLS = 1e-8
Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass(frozen=True)
class Trial:
    """A point on a line: the step, value and slope there, and the gradient."""

    t: float
    value: float
    slope: float
    gradient: np.ndarray


def _between(a: Trial, b: Trial) -> float:
    """Where the cubic through both values and slopes has its minimum; the parabola's through a and b's value, or the middle, where there is none."""
    width = b.t - a.t
    if math.isfinite(b.value):
        mean = 3 * (a.value - b.value) / width + a.slope + b.slope
        under = mean * mean - a.slope * b.slope
        if under >= 0 and math.isfinite(under):
            root = math.copysign(math.sqrt(under), width)
            down = b.slope - a.slope + 2 * root
            if down:
                return b.t - width * (b.slope + root - mean) / down
        bend = b.value - a.value - a.slope * width
        if bend > 0:
            return a.t - a.slope * width * width / (2 * bend)
    return a.t + width / 2


def line_search(at: Callable[[float], Trial], start: Trial, t: float, most: int = 30) -> Trial:
    """A step at which the value has fallen enough and the slope is small (strong Wolfe), the best found if `most` trials give none.

    The interval of uncertainty has its better end first. It grows by extrapolation until it holds a minimum, then shrinks by cubic
    or quadratic steps; steps that would leave it or hug an end are pulled inside, and an interval that shrinks too slowly is halved.
    """
    best, other, width = start, None, math.inf
    for _ in range(most):
        new = at(t)
        low = math.isfinite(new.value) and new.value <= start.value + DECREASE * new.t * start.slope
        if low and abs(new.slope) <= -CURVATURE * start.slope:
            return new
        if not low or new.value >= best.value:
            other = new
        else:
            if new.slope * (new.t - best.t) >= 0:
                other = best
            best = new
        if other is None:
            # Still falling: on to where the cubic of the first and the last point has its minimum.
            guess = _between(start, new)
            t = min(max(guess, 2 * new.t), FARTHEST * new.t) if guess > new.t else 4 * new.t
            continue
        if abs(other.t - best.t) <= NARROWEST * max(abs(best.t), abs(other.t)):
            break  # what is left of the interval is rounding, as of sums so large that values near the minimum are all the same
        guess, edge = _between(best, other), 0.1 * abs(other.t - best.t)
        low_t, high_t = min(best.t, other.t) + edge, max(best.t, other.t) - edge
        if abs(other.t - best.t) > 0.66 * width or not math.isfinite(guess):
            guess = (best.t + other.t) / 2
        width = abs(other.t - best.t)
        t = min(max(guess, low_t), high_t)
    return best


def lbfgs(f: Objective, x, memory: int = 3, iterations: int = 200, eps: float = 1e-3, report: Callable[[dict], None] | None = None) -> np.ndarray:
    """Minimise f (value, gradient) until |g| <= eps max(1, |x|): two-loop recursion with `line_search`. `report` gets iteration,
    evaluations, value, norm (of the gradient) and step before the first and after each iteration."""
    x, evaluations = np.atleast_1d(np.asarray(x, float)), 0

    def evaluated(point: np.ndarray) -> tuple[float, np.ndarray]:
        nonlocal evaluations
        evaluations += 1
        return f(point)

    value, g = evaluated(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    taken = 0.0
    for iteration in range(iterations + 1):
        if report is not None:
            report({"iteration": iteration, "evaluations": evaluations, "value": value, "norm": float(np.linalg.norm(g)), "step": taken})
        if iteration == iterations or np.linalg.norm(g) <= eps * max(1.0, np.linalg.norm(x)):
            break
        q, left = g.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (y @ s)
            q -= a * y
            left.append(a)
        if steps:
            s, y = steps[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(left), strict=True):
            q += s * (a - y @ q / (y @ s))
        if q @ g <= 0:  # no descent: start over from the gradient
            q, steps = g.copy(), []

        def at(t: float, x=x, q=q) -> Trial:
            v, h = evaluated(x - t * q)
            return Trial(t, v, -float(h @ q), h)

        found = line_search(at, Trial(0.0, value, -float(g @ q), g), 1.0 if steps else min(1.0, 1 / np.linalg.norm(g)))
        if found.value >= value:
            break
        s, y = -found.t * q, found.gradient - g
        if s @ y > 1e-12:
            steps = [*steps[-(memory - 1) :], (s, y)] if memory > 1 else [(s, y)]
        x, value, g, taken = x + s, found.value, found.gradient, found.t
    return x


class Likelihood:
    """The summed log-likelihood of `vectors` (docset and the other `keys`, term, cnt) by beta.

    What it needs of the data is how often each count occurs and how often each (w, N): one small table of (w, c, m), counts with w = 1 and
    m > 0, totals with m < 0, that is made once; each evaluation is one aggregation of it. Vectors are read once: both come from how often
    each vector has each count.
    """

    def __init__(self, vectors: DataFrame, sizes: DataFrame, *keys: str):
        one = F.count(F.lit(1))
        found = materialize(vectors.groupBy(*keys, F.col("cnt").alias("c")).agg(one.alias("m")), "vector-counts")
        counts = found.groupBy("c").agg(F.sum("m").alias("m")).select(F.lit(1).cast("long").alias("w"), "c", "m")
        totals = found.groupBy(*keys).agg(F.sum(F.col("c") * F.col("m")).alias("c")).join(sizes, "docset").groupBy("w", "c").agg((-one).alias("m"))
        self._begin(materialize(counts.unionByName(totals), "counts-of-counts"))

    def _begin(self, table: DataFrame) -> None:
        self.table, self.known = table, {}

    @classmethod
    def of_tallies(cls, tallies: DataFrame) -> Likelihood:
        """Of such a table, (w, c, m), that is there already."""
        out = cls.__new__(cls)
        out._begin(tallies)
        return out

    def __call__(self, beta: float) -> tuple[float, float]:
        """Value and slope."""
        if beta not in self.known:
            m, w, c = F.col("m"), F.col("w"), F.col("c")
            value, slope = self.table.agg(F.sum(m * rising(w * beta, c)), F.sum(m * w * digamma_rise(w * beta, c))).first()
            self.known[beta] = value or 0.0, slope or 0.0
        return self.known[beta]

    def best(self, start: float = 0.1, report: Callable[[dict], None] | None = None) -> float:
        """The beta of the largest value, by L-BFGS on log beta, until the slope is small or as small as values of this size can tell."""

        def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
            beta = float(np.exp(np.clip(x[0], -20, 5)))
            value, slope = self(beta)
            return -value, np.array([-slope * beta])

        first = np.array([math.log(start)])
        return float(np.exp(lbfgs(objective, first, eps=max(1e-4, TELLS * abs(objective(first)[0])), report=report)[0]))


def estimate_beta(vectors: DataFrame, sizes: DataFrame, *keys: str, start: float = 0.1) -> float:
    """The beta that maximises the summed log-likelihood of `vectors` (docset and the other `keys`, term, cnt)."""
    return Likelihood(vectors, sizes, *keys).best(start)


def alternation(segment: Callable[[float], DataFrame], bow: DataFrame, sizes: DataFrame, start: float = 0.1, rounds: int = 20, places: int = 4) -> list[dict]:
    """Segment with the current beta, estimate beta on the segments, until it stays as it is in `places` places, in which it is carried on.

    `segment` gives (docset, doc_id, seg, start, end) for a beta. Returns of each round: round, segments (how many), before (the
    log-likelihood of these segments at the beta they were made with), beta (the new one) and after (the log-likelihood at that).
    """

    def made(beta: float) -> tuple[int, Likelihood]:
        pieces = materialize(segment(beta).select("docset", "doc_id", "seg", "start", "end"), "em-pieces")
        words = bow.join(pieces, ["docset", "doc_id"]).where("pos >= start AND pos < end")
        vectors = materialize(words.groupBy("docset", "doc_id", "seg", "term").agg(F.sum("cnt").alias("cnt")), "em-vectors")
        return pieces.count(), Likelihood(vectors, sizes, "docset", "doc_id", "seg")

    return _alternation(made, start, rounds, places)


def alternation_tallied(tallies: Callable[[float], DataFrame], start: float = 0.1, rounds: int = 20, places: int = 4) -> list[dict]:
    """`alternation` where `tallies` gives, for a beta, what `dp.tallied_segments` does: segments are counted where they are made."""

    def made(beta: float) -> tuple[int, Likelihood]:
        found = materialize(tallies(beta).coalesce(1), "em-tallies")
        number = found.where("w = 0").agg(F.sum("m")).first()[0]
        return number or 0, Likelihood.of_tallies(found.where("w > 0"))

    return _alternation(made, start, rounds, places)


def _alternation(made: Callable[[float], tuple[int, Likelihood]], start: float, rounds: int, places: int) -> list[dict]:
    """`made` gives the number of segments made with a beta, and their likelihood."""
    out, beta = [], start
    for number in range(1, rounds + 1):
        many, of = made(beta)
        new = round(of.best(beta), places)
        out.append({"round": number, "segments": many, "before": of(beta)[0], "beta": new, "after": of(new)[0]})
        if new == beta:
            break
        beta = new
    return out


def alternate(segment: Callable[[float], DataFrame], bow: DataFrame, sizes: DataFrame, start: float = 0.1, rounds: int = 20, places: int = 4) -> float:
    """The beta that `alternation` ends with."""
    return alternation(segment, bow, sizes, start, rounds, places)[-1]["beta"]

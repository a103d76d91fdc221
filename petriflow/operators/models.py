"""Models fitted by statistics that Spark sums: each step is one pass over the rows, in which tasks add up a few numbers and hand on nothing else."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a task makes of a batch at a time, at most about.
CELLS = 4 << 20


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Columns of a batch; lists of one length become a matrix."""
    out = []
    for c in batch.columns:
        x = c.flatten() if pa.types.is_list(c.type) else c
        x = x.to_numpy(zero_copy_only=False)
        out.append(x.reshape(batch.num_rows, -1) if pa.types.is_list(c.type) else x)
    return out


def summed(rows: DataFrame, size: int, of: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``of(*columns)``, ``size`` numbers for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(*_columns(b))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "x"])

    out = np.zeros(size)
    for i, x in rows.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    return out


# --- logistic regressions that each leave a group out


@dataclass
class HeldOut:
    """One model for each group, fitted to all rows but the group's: weights (groups, features + 1), the intercept last."""

    weights: np.ndarray
    steps: int

    def score(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Probabilities of rows by their own group's model, which has not seen them."""
        w = self.weights[g]
        return 1 / (1 + np.exp(-np.clip((x * w[:, :-1]).sum(1) + w[:, -1], -35, 35)))


def held_out_logistic(rows: DataFrame, groups: int, features: int, penalty: Callable[[np.ndarray], np.ndarray], most_steps: int = 40, tol: float = 1e-8) -> HeldOut:
    """Logistic regressions over rows (x array<double>, y double, g int from 0), for every group one that leaves it out, all at once.

    Each minimises the mean loss over its rows plus half ``penalty(rows of each)`` times the squared weights of its standardised features. A Newton step of
    all models is one pass: rows add to gradient and curvature of every model but their own group's. A step that makes a model's loss larger is
    halved. The number of passes doesn't grow with the groups; sums of groups x (features + 1)^2 numbers come to the driver.
    """
    d = features

    def moments(x: np.ndarray, y: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.zeros((groups, 2 * d + 2))
        np.add.at(out, g, np.column_stack([np.ones(len(x)), y, x, x * x]))
        return out.ravel()

    by = summed(rows, groups * (2 * d + 2), moments).reshape(groups, -1)
    rest = by.sum(0) - by  # what each model sees
    n = np.maximum(rest[:, 0], 1)
    mean = rest[:, 2 : 2 + d] / n[:, None]
    var = np.maximum(rest[:, 2 + d :] - n[:, None] * mean**2, 0) / np.maximum(n - 1, 1)[:, None]
    sd = np.where(var > 1e-24, np.sqrt(var), 1.0)
    ridge = penalty(n)
    share = np.clip(rest[:, 1] / n, 1e-6, 1 - 1e-6)
    # In standardised features the curvature is well scaled: z = (x - mean) / sd of each model.
    w = np.column_stack([np.zeros((groups, d)), np.log(share / (1 - share))])

    def of(w: np.ndarray):
        def sums(x: np.ndarray, y: np.ndarray, g: np.ndarray) -> np.ndarray:
            out = np.zeros((groups, 1 + (d + 1) + (d + 1) ** 2))
            step = max(1, CELLS // (groups * (d + 1)))
            for low in range(0, len(x), step):
                xs, ys, gs = (a[low : low + step] for a in (x, y, g))
                z = np.concatenate([(xs[:, None, :] - mean[None]) / sd[None], np.ones((len(xs), groups, 1))], axis=2)
                t = np.clip(np.einsum("ngd,gd->ng", z, w), -35, 35)
                p, seen = 1 / (1 + np.exp(-t)), gs[:, None] != np.arange(groups)[None]
                out[:, 0] += np.where(seen, np.logaddexp(0, t) - ys[:, None] * t, 0).sum(0)
                out[:, 1 : d + 2] += np.einsum("ng,ngd->gd", np.where(seen, p - ys[:, None], 0), z)
                out[:, d + 2 :] += np.einsum("ng,ngd,nge->gde", np.where(seen, p * (1 - p), 0), z, z, optimize=True).reshape(groups, -1)
            return out.ravel()

        return sums

    pen = np.column_stack([np.repeat(ridge[:, None], d, 1), np.zeros(groups)])
    old, old_loss, steps = w, np.full(groups, np.inf), 0
    for steps in range(1, most_steps + 1):
        s = summed(rows, groups * (1 + (d + 1) + (d + 1) ** 2), of(w)).reshape(groups, -1)
        loss = s[:, 0] / n + (pen * w * w).sum(1) / 2
        worse = loss > old_loss + 1e-12
        gradient = s[:, 1 : d + 2] / n[:, None] + pen * w
        curvature = s[:, d + 2 :].reshape(groups, d + 1, d + 1) / n[:, None, None] + np.eye(d + 1)[None] * (pen[:, :, None] + 1e-12)
        new = w - np.linalg.solve(curvature, gradient[..., None])[..., 0]
        new[worse] = (w[worse] + old[worse]) / 2
        old, old_loss = np.where(worse[:, None], old, w), np.where(worse, old_loss, loss)
        moved = np.abs(new - w).max()
        w = new
        if moved < tol:
            break
    slope = w[:, :d] / sd
    return HeldOut(np.column_stack([slope, w[:, d] - (slope * mean).sum(1)]), steps)


def held_out_scores(rows: DataFrame, model: HeldOut, kept: list[str]) -> DataFrame:
    """``kept`` columns of ``rows`` (x, g, ...) and ``score``, by each row's own group's model."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, g = _columns(b.select(["x", "g"])) if b.num_rows else (np.empty((0, model.weights.shape[1] - 1)), np.empty(0, int))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(model.score(x, g))], [*kept, "score"])

    return rows.select(*kept, *(c for c in ("x", "g") if c not in kept)).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", score double")


# --- a Dirichlet-process mixture


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma for positive numbers: recurrence up to 10, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 10).any():
        small = x < 10
        out = np.where(small, out - 1 / np.where(small, x, 1), out)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


@dataclass
class Mixture:
    """Posterior of a truncated Dirichlet-process mixture of Gaussians with diagonal covariances: sticks (a, b), and a normal-gamma for each component."""

    a: np.ndarray
    b: np.ndarray
    means: np.ndarray
    strength: np.ndarray  # of the means, in rows
    freedom: np.ndarray
    variances: np.ndarray
    steps: int = 0

    @classmethod
    def of(cls, n: np.ndarray, first: np.ndarray, second: np.ndarray, prior: float, mean: np.ndarray, var: np.ndarray) -> Mixture:
        """From each component's weight, sum and sum of squares of the rows. Prior: sticks of Beta(1, ``prior``), means at ``mean`` with the strength of a row,
        variances ``var`` with as many degrees of freedom as there are features."""
        n = n + 1e-15
        centre = first / n[:, None]
        spread = np.maximum(second / n[:, None] - centre**2, 0) + 1e-6
        strength, freedom = 1 + n, len(mean) + n
        means = (mean + first) / strength[:, None]
        variances = (var + n[:, None] * (spread + (centre - mean) ** 2 / strength[:, None])) / freedom[:, None]
        return cls(1 + n, prior + np.concatenate([np.cumsum(n[::-1])[-2::-1], [0]]), means, strength, freedom, variances)

    @property
    def weights(self) -> np.ndarray:
        """Expected shares of the components."""
        stick = self.a / (self.a + self.b)
        share = stick * np.concatenate([[1], np.cumprod(1 - stick)[:-1]])
        return share / share.sum()

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Expected log of each component's share and density at rows."""
        d, both = x.shape[1], digamma(self.a + self.b)
        share = digamma(self.a) - both + np.concatenate([[0], np.cumsum(digamma(self.b[:-1]) - both[:-1])])
        off = ((x[:, None, :] - self.means[None]) ** 2 / self.variances[None]).sum(2)
        scale = d * np.log(2) + digamma(0.5 * (self.freedom[:, None] - np.arange(d)[None])).sum(1) - d * np.log(self.freedom)
        return share + 0.5 * (scale - d / self.strength - d * np.log(2 * np.pi) - np.log(self.variances).sum(1) - off)

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        parts = self.log_parts(x)
        top = parts.max(1)
        return top + np.log(np.exp(parts - top[:, None]).sum(1))


def dirichlet_mixture(rows: DataFrame, start: np.ndarray, prior: float = 1e-2, most_steps: int = 200, tol: float = 1e-3) -> Mixture:
    """Variational fit to rows (x array<double>), begun with each row in the nearest of the centres ``start``, one a component. A step is one pass that sums
    weights, values and squares by component; it ends when the rows' mean log-likelihood changes by less than ``tol``."""
    k, d = start.shape
    whole = summed(rows, 2 * d + 1, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    n = max(whole[0], 2)
    mean = whole[1 : d + 1] / n
    var = np.maximum(whole[d + 1 :] - n * mean**2, 1e-12) / (n - 1)

    def sums(responsible: Callable[[np.ndarray], tuple[np.ndarray, float]]) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            out = np.zeros(1 + k * (2 * d + 1))
            step = max(1, CELLS // (k * d))
            for low in range(0, len(x), step):
                some = x[low : low + step]
                r, total = responsible(some)
                out += np.concatenate([[total], r.sum(0), (r.T @ some).ravel(), (r.T @ (some * some)).ravel()])
            return out

        return summed(rows, 1 + k * (2 * d + 1), of)

    def nearest(x: np.ndarray) -> tuple[np.ndarray, float]:
        own = ((x[:, None, :] - start[None]) ** 2).sum(2).argmin(1)
        return (own[:, None] == np.arange(k)[None]).astype(float), 0.0

    def by(model: Mixture):
        def responsible(x: np.ndarray) -> tuple[np.ndarray, float]:
            parts, total = model.log_parts(x), model.log_likelihood(x)
            return np.exp(parts - total[:, None]), float(total.sum())

        return responsible

    responsible, before = nearest, -np.inf
    for step in range(1, most_steps + 1):
        s = sums(responsible)
        model = Mixture.of(s[1 : k + 1], s[k + 1 : k + 1 + k * d].reshape(k, d), s[k + 1 + k * d :].reshape(k, d), prior, mean, var)
        model.steps = step
        if step > 1 and abs(s[0] / n - before) < tol:
            break
        before = s[0] / n if step > 1 else -np.inf
        responsible = by(model)
    return model

"""Fits with a likelihood of choice, linear constraints, a prior and a noise level that is estimated on the way."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.operators.signals import global_noise, spread
from voxelspark.plans.models import MODELS, FitOptions, Model, jacobian, weighted_square
from voxelspark.plans.rice import bessel_ratio, rice_information, rice_loglik
from voxelspark.plans.starts import nnls_normal
from voxelspark.sources.store import remove, stored

ROBUST = 16.0  # squared residual, in noise levels, at which the tails begin


@dataclass(frozen=True)
class Likelihood:
    """Of an image type: log density, its slope in the prediction and a weight for scoring steps, each of (data, prediction, sigma).

    turn maps data, prediction and Jacobian to what is compared; without_noise
    says that the noise level does not move the optimum.
    """

    value: Callable
    slope: Callable
    weight: Callable
    turn: Callable = lambda y, a, j: (y, a, j)
    without_noise: bool = False


def _normal(y, a, s):
    return -((y - a) ** 2) / (2 * s * s) - np.log(s) - 0.5 * math.log(2 * math.pi)


def _robust(y, a, s):
    r = ((y - a) / s) ** 2
    return -2 * ROBUST**0.75 * ((r + ROBUST) ** 0.25 - ROBUST**0.25) - np.log(s) - 0.5 * math.log(2 * math.pi)


def _fall(y, a, s):
    """Weight of a residual against that of a normal one."""
    return (1 + ((y - a) / s) ** 2 / ROBUST) ** -0.75


def _phase(y, a, j):
    """Phases as points on the circle, so that they do not wrap."""
    both = lambda x: np.concatenate([np.cos(x), np.sin(x)], axis=1)
    return both(y), both(a), None if j is None else np.concatenate([-np.sin(a)[..., None] * j, np.cos(a)[..., None] * j], axis=1)


_flat = lambda y, a, s: (y - a) / s**2
_even = lambda y, a, s: 1 / s**2 + 0 * a

#: Image types. Complex data and predictions are real parts, then imaginary parts.
LIKELIHOODS: dict[str, Likelihood] = {
    "magnitude": Likelihood(
        lambda y, a, s: rice_loglik(y, a, s),
        lambda y, a, s: np.where(a < 0, -1, 1) * (y * bessel_ratio(y * np.abs(a) / s**2)[1] - np.abs(a)) / s**2,
        lambda y, a, s: np.maximum(rice_information(a / s), 1e-3) / s**2,
    ),
    "real": Likelihood(_normal, _flat, _even, without_noise=True),
    "complex": Likelihood(_normal, _flat, _even, without_noise=True),
    "phase": Likelihood(_normal, _flat, _even, _phase, without_noise=True),
    "robust": Likelihood(_robust, lambda y, a, s: _fall(y, a, s) * (y - a) / s**2, lambda y, a, s: _fall(y, a, s) / s**2),
}


@dataclass(frozen=True)
class Constraints:
    """Bounds of the parameters and rows of a theta <= b, the same for all voxels."""

    lower: tuple[float, ...] = ()
    upper: tuple[float, ...] = ()
    a: tuple[tuple[float, ...], ...] = ()
    b: tuple[float, ...] = ()

    def rows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All of them as a theta <= b, rows of length 1."""
        eye, out, right = np.eye(n), [], []
        for k, (bounds, sign) in enumerate(((self.lower, -1.0), (self.upper, 1.0))):
            for i, v in enumerate(bounds):
                if v is not None and math.isfinite(v):
                    out.append(sign * eye[i])
                    right.append(sign * v)
        out, right = np.array([*out, *self.a], float).reshape(-1, n), np.array([*right, *self.b], float)
        size = np.linalg.norm(out, axis=1)
        if len(out) != len(right) or (size == 0).any():
            raise ValueError("constraints need as many rows as limits, and no empty row")
        return out / size[:, None], right / size


def log_mvn_prior(theta: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """Log of an unnormalised normal prior of each row of theta."""
    d = theta - mean
    return -0.5 * np.einsum("vi,ij,vj->v", d, np.linalg.inv(covariance), d)


def constrained_step(theta: np.ndarray, h: np.ndarray, g: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step that maximises g d - d h d / 2 with a (theta + d) <= b, for each voxel, and the multipliers.

    The dual of that problem is a non-negative least-squares problem in the
    multipliers: the rows with a positive one are the active set.
    """
    free = np.linalg.solve(h, g[..., None])[..., 0]
    if not len(a):
        return free, np.zeros((len(theta), 0))
    across = np.linalg.solve(h, np.broadcast_to(a.T, (len(h), *a.T.shape)))
    inner = np.einsum("ri,vis->vrs", a, across)
    size = np.sqrt(np.maximum(np.einsum("vrr->vr", inner), 1e-300))
    over = np.einsum("ri,vi->vr", a, theta + free) - b
    m = nnls_normal(inner / size[:, :, None] / size[:, None, :], over / size) / size
    return free - np.einsum("vir,vr->vi", across, m), m


def maximise(model: Model, kind: str, theta: np.ndarray, data: np.ndarray, sigma: np.ndarray, protocol: np.ndarray, fields: np.ndarray, o: FitOptions, limits: tuple[np.ndarray, np.ndarray], prior: tuple[np.ndarray, np.ndarray] | None, iterations: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Damped scoring steps within the constraints: theta, log likelihood with prior, iterations. A start outside is first moved to the nearest point inside."""
    like, (a, b) = LIKELIHOODS[kind], limits
    theta = theta + constrained_step(theta, np.broadcast_to(np.eye(model.n), (len(theta), model.n, model.n)), np.zeros(theta.shape), a, b)[0]
    inverse = np.linalg.inv(prior[1]) if prior else None

    def value(t: np.ndarray, at: np.ndarray) -> np.ndarray:
        y, p, _ = like.turn(data[at], model.signal(t, protocol, fields[at], o), None)
        out = like.value(y, p, sigma[at, None]).sum(1)
        out = out + log_mvn_prior(t, *prior) if prior else out
        return np.where(np.isfinite(out), out, -np.inf)

    active = np.arange(len(theta))
    best, damp, count = value(theta, active), np.full(len(theta), 1e-3), np.zeros(len(theta), int)
    for _ in range(iterations):
        if not len(active):
            break
        t, s = theta[active], sigma[active, None]
        y, p, j = like.turn(data[active], model.signal(t, protocol, fields[active], o), jacobian(model, t, protocol, fields[active], o))
        g, h = (j.transpose(0, 2, 1) @ like.slope(y, p, s)[..., None])[..., 0], weighted_square(j, like.weight(y, p, s))
        if prior:
            g, h = g - (t - prior[0]) @ inverse, h + inverse
        diag = np.einsum("vii->vi", h)
        h = h + np.einsum("vi,ij->vij", diag * damp[active, None] + 1e-12 * diag.max(1, keepdims=True) + 1e-300, np.eye(model.n))
        new = t + constrained_step(t, h, g, a, b)[0]
        after = value(new, active)
        good = after >= best[active]
        settled = good & (after - best[active] < 1e-10 * (1 + np.abs(best[active]))) | (damp[active] > 1e12)
        count[active] += 1
        theta[active[good]], best[active[good]] = new[good], after[good]
        damp[active] = np.where(good, damp[active] / 10, damp[active] * 10)
        active = active[~settled]
    return theta, best, count


def _once(df: DataFrame, rows: list[tuple], m: Model, kind: str, o: FitOptions, limits: tuple, prior: tuple | None, iterations: int) -> DataFrame:
    """One fit (none with iterations 0) of all voxels with theta and sigma: theta, loglik, rss, iterations; signal is kept."""
    full = np.concatenate([np.array([r[1:5] for r in rows], float)] * m.times)
    keep = [c for c in df.columns if c not in ("theta", "loglik", "rss", "iterations")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = [t is not None and y is not None and np.isfinite(y).all() for t, y in zip(pdf["theta"], pdf["signal"])]
            if not all(whole):
                yield pdf.loc[~np.array(whole), keep].assign(theta=None, loglik=None, rss=None, iterations=None)
            pdf = pdf[whole]
            if not len(pdf):
                continue
            data, theta = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("signal", "theta"))
            if kind == "magnitude":
                data = np.where(data > 0, data, np.finfo(float).eps)
            f = np.stack(pdf["f"].to_numpy()).astype(float) if "f" in pdf else np.zeros((len(pdf), max(6, m.n_fields)))
            sigma = np.maximum(pdf["sigma"].to_numpy(float), 1e-12 * np.maximum(np.abs(data).max(1), 1e-300))
            theta, value, count = maximise(m, kind, theta, data, sigma, full, f, o, limits, prior, iterations)
            y, p, _ = LIKELIHOODS[kind].turn(data, m.signal(theta, full, f, o), None)
            yield pdf[keep].assign(theta=list(theta.tolist()), loglik=value, rss=((y - p) ** 2).sum(1), iterations=count)

    types = dict(df.dtypes)
    return spread(df).mapInPandas(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], "theta array<double>, loglik double, rss double, iterations int"]))


def fit_general(df: DataFrame, rows: list[tuple], model: str, kind: str = "magnitude", sigma: float | None = None, constraints: Constraints | None = None, prior: tuple | None = None, accept: tuple[float, float] = (0.8, 1.25), rounds: int = 5, options: FitOptions | None = None) -> DataFrame:
    """Maximum likelihood of an image type from the starts in theta, within linear constraints and under a normal prior (mean, covariance) of theta.

    df has scan_id, signal, theta (and f). Complex data are real parts, then
    imaginary parts, and the model gives them so; phases are compared on the
    circle. The noise level of a scan is `sigma`, or is estimated: the median
    over its voxels of sqrt(rss / (data - parameters)) at the current theta,
    and the fit is done again, from its last result, while the level that it
    used is outside accept times the new one in any scan, `rounds` times at
    most. Types whose optimum does not follow the noise level are fitted once.
    Each round is written to shared storage. A voxel without theta or with a
    datum that is null or not finite keeps a null theta. Returns all other
    columns with theta, sigma, loglik (of the prior too), rss, iterations.
    """
    m, o, like = MODELS[model], options or FitOptions(), LIKELIHOODS[kind]
    limits = (constraints or Constraints()).rows(m.n)
    prior = tuple(np.asarray(x, float) for x in prior) if prior else None
    fit = lambda d, n: _once(d, rows, m, kind, o, limits, prior, n)
    df = df.drop("sigma")
    if sigma is not None:
        return fit(df.withColumn("sigma", F.lit(float(sigma))), 60)
    n = len(rows) * m.times * (2 if kind in ("complex", "phase") else 1)
    spark, held, used = df.sparkSession, [], None
    state, path = stored(fit(df.withColumn("sigma", F.lit(1.0)), 0))
    held.append(path)
    for k in range(rounds + 1):
        level = {r.scan_id: r.noise for r in global_noise(state, "lsqmodel", n, m.n).collect()}  # a row for each scan
        fine = used is not None and all(used[s] is None or v is None or accept[0] * v <= used[s] <= accept[1] * v for s, v in level.items())
        if fine or k == rounds or k == 1 and like.without_noise:
            break
        used = level
        levels = spark.createDataFrame(list(level.items()), f"scan_id {dict(state.dtypes)['scan_id']}, sigma double")
        state, path = stored(fit(state.drop("sigma").join(F.broadcast(levels), "scan_id"), 60))
        held.append(path)
    for p in held[:-1]:
        remove(spark, p)
    return state

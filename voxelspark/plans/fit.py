"""Fitting jobs: every Arrow batch of voxels is a few vectorised solves. One row in, one row out; fits are dealt over all tasks first (see spread)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.operators.blocks import AXES, Size, block_sweep, laplacian
from voxelspark.operators.grid import laplacian_penalty
from voxelspark.operators.signals import log_linear_operator, spread
from voxelspark.plans.maps import derive_maps as derive_maps
from voxelspark.plans.models import MODELS, FitOptions, Model, jacobian, signal_and_slopes, weighted_square
from voxelspark.plans.rice import bessel_ratio, log_rice_logsigma, rice_information, rice_information_joint, rice_loglik
from voxelspark.plans.starts import candidates, given_starts, rank_starts
from voxelspark.sources.store import remove, stored


def bound(theta: np.ndarray, model: Model) -> np.ndarray:
    """Bounded parameters by their sine map, so that any real value is allowed."""
    out, i = theta.copy(), list(model.bounded)
    out[:, i] = np.arcsin(2 * np.clip(theta[:, i], 2.2e-16, 1 - 2.2e-16) - 1)
    return out


def unbound(u: np.ndarray, model: Model) -> np.ndarray:
    out, i = u.copy(), list(model.bounded)
    out[:, i] = np.sin(u[:, i]) / 2 + 0.5
    return out


def _slopes(u: np.ndarray, model: Model) -> np.ndarray:
    out, i = np.ones_like(u), list(model.bounded)
    out[:, i] = np.cos(u[:, i]) / 2
    return out


#: Voxels that are solved together: as many as leave their derivatives in a core's cache.
TOGETHER = 512


def levenberg_marquardt(model: Model, theta: np.ndarray, data: np.ndarray, protocol: np.ndarray, fields: np.ndarray, o: FitOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares of all voxels; settled voxels leave. Returns theta, rss, iterations."""
    parts = [slice(lo, lo + TOGETHER) for lo in range(0, max(1, len(theta)), TOGETHER)]
    return tuple(np.concatenate(x) for x in zip(*[_least_squares(model, theta[at], data[at], protocol, fields[at], o) for at in parts]))


def _least_squares(model: Model, theta: np.ndarray, data: np.ndarray, protocol: np.ndarray, fields: np.ndarray, o: FitOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """See levenberg_marquardt. Derivatives are worked out anew only where the last step was taken."""
    u = bound(theta, model)
    damp, count, active, moved = np.full(len(u), 100.0), np.zeros(len(u), int), np.arange(len(u)), np.arange(len(u))
    rss = ((model.signal(unbound(u, model), protocol, fields, o) - data) ** 2).sum(1)
    curve, pull = np.empty((len(u), model.n, model.n)), np.empty((len(u), model.n))
    for _ in range(o.max_iterations):
        if not len(active):
            break
        if len(moved):
            x = u[moved]
            a, j = signal_and_slopes(model, unbound(x, model), protocol, fields[moved], o)
            j *= _slopes(x, model)[:, :, None]
            curve[moved], pull[moved] = j @ j.transpose(0, 2, 1), (j @ (a - data[moved])[..., None])[..., 0]
        x, d, h, g = u[active], data[active], curve[active], pull[active]
        diag = np.einsum("vii->vi", h)
        frozen = diag <= 1e-10 * diag.max(1, keepdims=True)
        g = np.where(frozen, 0, g)
        h = h + np.einsum("vi,ij->vij", np.where(frozen, 1.0, diag * damp[active, None]) + 1e-300, np.eye(model.n))
        new = x - np.linalg.solve(h, g[..., None])[..., 0]
        after = ((model.signal(unbound(new, model), protocol, fields[active], o) - d) ** 2).sum(1)
        good = after < rss[active]
        settled = good & ((rss[active] - after < 1e-8 * (rss[active] + 1e-300)) | (np.abs(new - x).max(1) < 1e-8)) | (damp[active] > 1e10)
        count[active] += 1
        u[active[good]], rss[active[good]] = new[good], after[good]
        damp[active] = np.where(good, damp[active] / 10, damp[active] * 10)
        active, moved = active[~settled], active[good & ~settled]
    return unbound(u, model), rss, count


def maximise_rice(model: Model, theta: np.ndarray, data: np.ndarray, sigma: np.ndarray, protocol: np.ndarray, fields: np.ndarray, o: FitOptions, iterations: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Rice maximum likelihood by damped Fisher scoring (sigma per voxel); pseudo-data stay Gaussian."""
    n = data.shape[1] - model.pseudo

    def value(u: np.ndarray, idx: np.ndarray) -> np.ndarray:
        a = model.signal(unbound(u, model), protocol, fields[idx], o)
        out = rice_loglik(data[idx, :n], a[:, :n], sigma[idx, None]).sum(1)
        return out - ((a[:, n:] - data[idx, n:]) ** 2).sum(1) / (2 * o.prior_noise**2)

    u, every = bound(theta, model), np.arange(len(theta))
    best, damp, active = value(u, every), np.full(len(theta), 1e-3), every
    for _ in range(iterations):
        if not len(active):
            break
        x, f, s = u[active], fields[active], sigma[active, None]
        t = unbound(x, model)
        a = model.signal(t, protocol, f, o)
        j = jacobian(model, t, protocol, f, o) * _slopes(x, model)[:, None, :]
        ratio = bessel_ratio(data[active, :n] * np.abs(a[:, :n]) / s**2)[1]
        e = np.concatenate([(data[active, :n] * ratio - a[:, :n]) / s**2, (data[active, n:] - a[:, n:]) / o.prior_noise**2], axis=1)
        weight = np.concatenate([np.broadcast_to(1 / s**2, (len(active), n)), np.full((len(active), model.pseudo), 1 / o.prior_noise**2)], axis=1)
        h = weighted_square(j, weight)
        diag = np.einsum("vii->vi", h)
        h = h + np.einsum("vi,ij->vij", diag * damp[active, None] + 1e-12 * diag.max(1, keepdims=True) + 1e-300, np.eye(model.n))
        new = x + np.linalg.solve(h, np.einsum("vmi,vm->vi", j, e)[..., None])[..., 0]
        after = value(new, active)
        good = after >= best[active]
        settled = good & (after - best[active] < 1e-9) | (damp[active] > 1e8)
        u[active[good]], best[active[good]] = new[good], after[good]
        damp[active] = np.where(good, damp[active] / 10, damp[active] * 10)
        active = active[~settled]
    return unbound(u, model), best


def maximise_rice_noise(model: Model, theta: np.ndarray, data: np.ndarray, sigma: np.ndarray, protocol: np.ndarray, fields: np.ndarray, o: FitOptions, iterations: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rice maximum likelihood of theta and of each voxel's log sigma together: theta, sigma, loglik (pseudo-data included).

    Damped scoring with the joint expected information: the block of log sigma
    and its cross block with theta count, so that a step moves both at once.
    """
    n = data.shape[1] - model.pseudo
    x = np.column_stack([bound(theta, model), np.log(sigma)])

    def value(x: np.ndarray, idx: np.ndarray) -> np.ndarray:
        a = model.signal(unbound(x[:, :-1], model), protocol, fields[idx], o)
        out = rice_loglik(data[idx, :n], a[:, :n], np.exp(x[:, -1:])).sum(1)
        return out - ((a[:, n:] - data[idx, n:]) ** 2).sum(1) / (2 * o.prior_noise**2)

    every = np.arange(len(theta))
    best, damp, active = value(x, every), np.full(len(theta), 1e-3), every
    for _ in range(iterations):
        if not len(active):
            break
        old, f = x[active], fields[active]
        t, s = unbound(old[:, :-1], model), old[:, -1:]
        a = model.signal(t, protocol, f, o)
        j = jacobian(model, t, protocol, f, o) * _slopes(old[:, :-1], model)[:, None, :]
        _, of_a, of_s, *_ = log_rice_logsigma(data[active, :n], a[:, :n], s)
        e = np.exp(s)
        aa, as_, ss = rice_information_joint(a[:, :n] / e)
        pull = np.concatenate([of_a, (data[active, n:] - a[:, n:]) / o.prior_noise**2], axis=1)
        weight = np.concatenate([aa / e**2, np.full((len(active), model.pseudo), 1 / o.prior_noise**2)], axis=1)
        g = np.column_stack([(j.transpose(0, 2, 1) @ pull[..., None])[..., 0], of_s.sum(1)])
        h = np.zeros((len(active), model.n + 1, model.n + 1))
        h[:, :-1, :-1] = weighted_square(j, weight)
        h[:, :-1, -1] = h[:, -1, :-1] = np.einsum("vmi,vm->vi", j[:, :n], np.where(a[:, :n] < 0, -as_, as_) / e)
        h[:, -1, -1] = ss.sum(1)
        diag = np.einsum("vii->vi", h)
        h = h + np.einsum("vi,ij->vij", diag * damp[active, None] + 1e-12 * diag.max(1, keepdims=True) + 1e-300, np.eye(model.n + 1))
        new = old + np.clip(np.linalg.solve(h, g[..., None])[..., 0], -2, 2)
        after = value(new, active)
        good = after >= best[active]
        settled = good & (after - best[active] < 1e-9) | (damp[active] > 1e8)
        x[active[good]], best[active[good]] = new[good], after[good]
        damp[active] = np.where(good, damp[active] / 10, damp[active] * 10)
        active = active[~settled]
    return unbound(x[:, :-1], model), np.exp(x[:, -1]), best


def _batch(pdf: pd.DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    data = np.stack(pdf["signal"].to_numpy()).astype(float)
    data = np.where(np.isfinite(data) & (data > 0), data, 2.220446049250313e-16)
    f = np.stack(pdf["f"].to_numpy()).astype(float) if "f" in pdf else np.zeros((len(pdf), max(6, model.n_fields)))
    return np.concatenate([data, np.zeros((len(data), model.pseudo))], axis=1), f


Starts = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def best_of(model: Model, found: Starts, data: np.ndarray, full: np.ndarray, fields: np.ndarray, o: FitOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Solve from each start (voxels, theta, number) and keep the smallest rss of each voxel, the earlier start in ties: theta, rss, number, iterations."""
    n = len(data)
    theta, rss, number, count = np.full((n, model.n), np.nan), np.full(n, np.inf), np.zeros(n, int), np.zeros(n, int)
    for at, t, k in found:
        if not len(at):
            continue
        x, r, i = levenberg_marquardt(model, t, data[at], full, fields[at], o)
        better = r < rss[at]
        to = at[better]
        theta[to], rss[to], number[to], count[to] = x[better], r[better], k[better], i[better]
    return theta, rss, number, count


def _fit(dwi: DataFrame, rows: list[tuple], m: Model, o: FitOptions, found, dealt: bool = False) -> DataFrame:
    """One row in, one row out: found(pdf, scale, data, fields) gives the starts of a batch."""
    p = np.array([r[1:5] for r in rows], float)
    full = np.concatenate([p] * m.times)
    keep = [c for c in dwi.columns if c not in ("signal", "f", "theta0", "more")]
    if m.n_fields and "f" not in dwi.columns:
        raise ValueError(f"{m.name} needs fields")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            data, f = _batch(pdf, m)
            scale = np.maximum(data[:, : len(full)].max(1), 1e-300)
            dead = scale < 1e-12
            d = data.copy()
            d[:, : len(full)] /= scale[:, None]
            theta, _, pick, count = best_of(m, found(pdf, scale, d, f), d, full, f, o)
            theta[:, list(m.s0)] *= scale[:, None]
            r = (m.signal(theta, full, f, o) - data)[:, : len(full)]
            out = pdf[keep].copy()
            out["theta"] = [None if z else list(t) for t, z in zip(theta.tolist(), dead | ~np.isfinite(theta).all(1))]
            out["rss"], out["start"], out["iterations"] = (r**2).sum(1), pick, count
            yield out

    types = dict(dwi.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", theta array<double>, rss double, start int, iterations int"
    return (dwi if dealt else spread(dwi)).mapInPandas(run, schema)


def _computed(m: Model, rows: list[tuple], o: FitOptions):
    p, operator = np.array([r[1:5] for r in rows], float), log_linear_operator(rows)

    def of(at: np.ndarray, d: np.ndarray, f: np.ndarray, first: int = 0) -> Starts:
        if len(at):
            for k, t in enumerate(candidates(m, d[at], p, operator, f[at], o)):
                yield at, t, np.full(len(at), first + k)

    return of


def fit_lsq(dwi: DataFrame, rows: list[tuple], model: str, options: FitOptions | None = None, dealt: bool = False) -> DataFrame:
    """Least-squares fit of every voxel: all columns but signal, f, theta0 and more, then theta, rss, start, iterations.

    dwi has a signal array (time points one behind the other) and, for models
    with fields, f. A voxel with a given start (column theta0, see
    with_initialisation) is solved from it, as start -1; the others from the
    model's computed starts. The candidate with the smallest rss is kept, ties
    keep the earlier start. rss leaves pseudo-data out. Voxels without any
    positive finite value get theta null. Signals are scaled to 1 for the solve.
    dealt says that the rows of dwi are dealt over tasks as they are, as those
    of simulate are; they are not shuffled again then.
    """
    m, o = MODELS[model], options or FitOptions()
    computed = _computed(m, rows, o)

    def found(pdf: pd.DataFrame, scale: np.ndarray, d: np.ndarray, f: np.ndarray) -> Starts:
        rest = np.arange(len(pdf))
        if "theta0" in pdf:
            for at, t in given_starts(pdf[["theta0"]], m, scale):
                yield at, t, np.full(len(at), -1)
                rest = np.setdiff1d(rest, at)
        yield from computed(rest, d, f)

    return _fit(dwi, rows, m, o, found, dealt)


#: Numbers of starts that are not rows of a start table: the given one, the neighbours' (downwards), the computed ones (downwards).
GIVEN, NEIGHBOUR, COMPUTED = -1, -2, -101


def multi_start(dwi: DataFrame, rows: list[tuple], model: str, table: DataFrame, keep: int = 1, linear: tuple[int, ...] | None = None, computed: bool = False, options: FitOptions | None = None) -> DataFrame:
    """fit_lsq from the `keep` best of many starts: those of `table` (start, theta; see start_table), the columns theta0 and more, and the computed ones.

    The parameters `linear` (the scale parameters by default) must be factors
    of summands of the signal: starts of the table are ranked at their best
    values. All other starts are ranked as they are. The table is the same for
    all voxels and goes to the tasks as a whole: its size is chosen by the
    caller and does not follow the data. Voxels are solved as in fit_lsq; the
    column start is the row of the table, or one of GIVEN, NEIGHBOUR, COMPUTED
    and downwards.
    """
    m, o = MODELS[model], options or FitOptions()
    linear = m.s0 if linear is None else linear
    full = np.concatenate([np.array([r[1:5] for r in rows], float)] * m.times)
    held = sorted((r.start, r.theta) for r in table.select("start", "theta").collect())
    numbers, thetas = np.array([k for k, _ in held], int), np.array([t for _, t in held], float).reshape(len(held), m.n)
    own = _computed(m, rows, o)

    def found(pdf: pd.DataFrame, scale: np.ndarray, d: np.ndarray, f: np.ndarray) -> Starts:
        n = len(pdf)
        value, theta, number = np.full((n, 0), np.inf), np.zeros((n, 0, m.n)), np.zeros((n, 0), int)

        def add(at: np.ndarray, t: np.ndarray, k: np.ndarray) -> None:
            nonlocal value, theta, number
            v, x, i = np.full(n, np.inf), np.zeros((n, m.n)), np.zeros(n, int)
            v[at], x[at], i[at] = ((m.signal(t, full, f[at], o) - d[at]) ** 2).sum(1), t, k
            value, theta, number = np.column_stack([value, v]), np.concatenate([theta, x[:, None]], axis=1), np.column_stack([number, i])

        for column, first in (("theta0", GIVEN), ("more", NEIGHBOUR)):
            if column in pdf:
                for k, (at, t) in enumerate(given_starts(pdf[[column]], m, scale)):
                    add(at, t, np.full(len(at), first - k))
        if computed:
            for at, t, k in own(np.arange(n), d, f):
                add(at, t, COMPUTED - k)
        if len(thetas):
            t, v, k = rank_starts(m, thetas, d, full, f, linear, keep, o)
            value, theta, number = np.column_stack([value, v]), np.concatenate([theta, t], axis=1), np.column_stack([number, numbers[k]])
        best = np.argsort(value, axis=1, kind="stable")[:, :keep]
        for k in range(best.shape[1]):
            at = np.flatnonzero(np.isfinite(value[np.arange(n), best[:, k]]))
            yield at, theta[at, best[at, k]], number[at, best[at, k]]

    return _fit(dwi, rows, m, o, found)


def fit_ml(fitted: DataFrame, rows: list[tuple], model: str, options: FitOptions | None = None, refine_noise: bool = False) -> DataFrame:
    """Rice maximum likelihood from a least-squares result: theta and loglik replaced, other columns kept.

    fitted has signal, theta, sigma (and f). With refine_noise each voxel's
    sigma is a parameter too and the column is replaced by its estimate. The
    better of start and optimum is kept. loglik leaves pseudo-data out. A voxel
    with a null theta keeps it, with a null loglik.
    """
    m, o = MODELS[model], options or FitOptions()
    full = np.concatenate([np.array([r[1:5] for r in rows], float)] * m.times)
    keep = [c for c in fitted.columns if c not in ("signal", "f", "theta", "loglik")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pdf["theta"].notna()
            if not found.all():
                yield pdf.loc[~found, keep].assign(theta=None, loglik=None)
            pdf = pdf[found]
            if not len(pdf):
                continue
            data, f = _batch(pdf, m)
            theta, sigma = np.stack(pdf["theta"].to_numpy()).astype(float), pdf["sigma"].to_numpy(float)
            out = pdf[keep].copy()
            if refine_noise:
                theta, sigma, _ = maximise_rice_noise(m, theta, data, sigma, full, f, o)
                out["sigma"] = sigma
            else:
                theta, _ = maximise_rice(m, theta, data, sigma, full, f, o)
            n = len(full)
            out["theta"], out["loglik"] = list(theta.tolist()), rice_loglik(data[:, :n], m.signal(theta, full, f, o)[:, :n], sigma[:, None]).sum(1)
            yield out

    types = dict(fitted.dtypes)
    return spread(fitted).mapInPandas(run, ", ".join([*[f"`{c}` {'double' if c == 'sigma' else types[c]}" for c in keep], "theta array<double>", "loglik double"]))


def _noise_block(m: Model, full: np.ndarray, o: FitOptions, weight: float, steps: int):
    """Solver of a block for regularise_noise: damped scoring steps on all of its voxels, coupled by their noise."""
    n = len(full)

    def solve(block: pd.DataFrame, own: np.ndarray) -> pd.DataFrame:
        at = block[list(AXES)].to_numpy()
        l = laplacian(at)  # noqa: E741
        touched = np.abs(l[:, own]).sum(1) > 0  # sums that the block's noise is part of
        l_own, sigma = l[np.ix_(touched, own)], block["sigma"].to_numpy(float)
        data, f = _batch(block[own], m)
        theta = np.stack(block.loc[own, "theta"].to_numpy()).astype(float)
        x = np.column_stack([bound(theta, m), np.log(sigma[own])])

        def value(x: np.ndarray) -> float:
            a = m.signal(unbound(x[:, :-1], m), full, f, o)
            out = -rice_loglik(data[:, :n], a[:, :n], np.exp(x[:, -1:])).sum()
            out += ((a[:, n:] - data[:, n:]) ** 2).sum() / (2 * o.prior_noise**2)
            s = sigma.copy()
            s[own] = np.exp(x[:, -1])
            return out + weight / 2 * ((l[touched] @ s) ** 2).sum()

        best, damp = value(x), 1e-3
        for _ in range(steps):
            t, s = unbound(x[:, :-1], m), x[:, -1:]
            a = m.signal(t, full, f, o)
            j = jacobian(m, t, full, f, o) * _slopes(x[:, :-1], m)[:, None, :]
            _, of_a, of_s, *_ = log_rice_logsigma(data[:, :n], a[:, :n], s)
            e = np.exp(s)
            aa, as_, ss = rice_information_joint(a[:, :n] / e)
            pull = np.concatenate([of_a, (data[:, n:] - a[:, n:]) / o.prior_noise**2], axis=1)
            heavy = np.concatenate([aa / e**2, np.full((len(x), m.pseudo), 1 / o.prior_noise**2)], axis=1)
            g, h = (j.transpose(0, 2, 1) @ pull[..., None])[..., 0], weighted_square(j, heavy)
            cross = np.einsum("vmi,vm->vi", j[:, :n], np.where(a[:, :n] < 0, -as_, as_) / e)
            own_s = sigma.copy()
            own_s[own] = e[:, 0]
            bend = weight * (l_own * e[:, 0]).T
            pull_s, heavy_s = of_s.sum(1) - bend @ (l[touched] @ own_s), bend @ (l_own * e[:, 0])
            while damp < 1e10:
                diag = np.einsum("vii->vi", h)
                solved = np.linalg.solve(h + np.einsum("vi,ij->vij", diag * damp + 1e-12 * diag.max(1, keepdims=True) + 1e-300, np.eye(m.n)), np.stack([g, cross], 2))
                left = np.diag(ss.sum(1) * (1 + damp) - (cross * solved[:, :, 1]).sum(1)) + heavy_s + damp * np.diag(np.diag(heavy_s))
                ds = np.linalg.solve(left, pull_s - (cross * solved[:, :, 0]).sum(1))
                new = x + np.clip(np.column_stack([solved[:, :, 0] - solved[:, :, 1] * ds[:, None], ds]), -2 * np.maximum(1, np.abs(x)), 2 * np.maximum(1, np.abs(x)))
                after = value(new)
                if after <= best:
                    break
                damp *= 10
            else:
                break
            moved, x, best, damp = best - after, new, after, damp / 10
            if moved < 1e-9 * max(1.0, abs(best)):
                break
        out = block[own].copy()
        out["theta"], out["sigma"] = list(unbound(x[:, :-1], m).tolist()), np.exp(x[:, -1])
        return out

    return solve


def regularise_noise(fitted: DataFrame, rows: list[tuple], model: str, weight: float, size: Size = (8, 8, 8), sweeps: int = 5, steps: int = 10, tolerance: float = 1e-6, options: FitOptions | None = None) -> tuple[DataFrame, list[float]]:
    """Rice maximum likelihood of theta and a noise field that is smooth in space, by block sweeps.

    The objective is minus the log likelihood of all voxels plus weight / 2
    times the squared Laplacian of sigma (see laplacian_penalty). fitted has
    scan_id, x, y, z, signal, theta, sigma (and f); voxels with a null theta
    take no part and are not returned. Within a block all voxels move
    together: theta is taken out voxel by voxel, what is left couples the
    noise of the block. Sweeps end when the objective falls by less than
    `tolerance` of itself. Returns the voxels with new theta, sigma, rss and
    loglik (pseudo-data left out; no signal), and the objective over all scans
    before the first and after each sweep; with pseudo-data it leaves them out.
    """
    m, o = MODELS[model], options or FitOptions()
    full = np.concatenate([np.array([r[1:5] for r in rows], float)] * m.times)
    state = fitted.where("theta is not null").withColumn("sigma", F.col("sigma").cast("double"))
    # fitted is mostly a fit: it is worked out once, not again for the objective and the sweeps
    state, path = stored(state.select(*[c for c in state.columns if c not in ("rss", "loglik")]))

    def objective(df: DataFrame) -> float:
        fit = fit_statistics(df, rows, model, o).agg(F.sum("loglik")).first()[0] or 0.0
        bend = laplacian_penalty(df.select("scan_id", *AXES, F.col("sigma").alias("v"))).agg(F.sum("penalty")).first()[0] or 0.0
        return weight * bend - fit

    history, out = [objective(state)], state
    for k, out in enumerate(block_sweep(state, _noise_block(m, full, o, weight, steps), size, 2)):
        history.append(objective(out))
        if k + 1 >= sweeps or history[-2] - history[-1] <= tolerance * abs(history[-1]):
            break
    if out is not state:  # no rows, no sweep
        remove(state.sparkSession, path)
    return fit_statistics(out, rows, model, o), history


def fit_statistics(fitted: DataFrame, rows: list[tuple], model: str, options: FitOptions | None = None) -> DataFrame:
    """rss and Rice log likelihood of each voxel's theta at its sigma, pseudo-data left out; null where theta is null.

    fitted has signal, theta, sigma (and f); its other columns are kept, rss and
    loglik are replaced.
    """
    m, o = MODELS[model], options or FitOptions()
    full = np.concatenate([np.array([r[1:5] for r in rows], float)] * m.times)
    keep = [c for c in fitted.columns if c not in ("signal", "f", "rss", "loglik")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pdf["theta"].notna()
            if not found.all():
                yield pdf.loc[~found, keep].assign(rss=None, loglik=None)
            pdf = pdf[found]
            if not len(pdf):
                continue
            data, f = _batch(pdf, m)
            data = data[:, : len(full)]
            a = m.signal(np.stack(pdf["theta"].to_numpy()).astype(float), full, f, o)[:, : len(full)]
            yield pdf[keep].assign(rss=((data - a) ** 2).sum(1), loglik=rice_loglik(data, a, pdf["sigma"].to_numpy(float)[:, None]).sum(1))

    types = dict(fitted.dtypes)
    return fitted.mapInPandas(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], "rss double", "loglik double"]))


def crlb(fitted: DataFrame, rows: list[tuple], model: str, rice: bool = True, options: FitOptions | None = None) -> DataFrame:
    """Upper triangle (row by row) of the variance bound of every voxel with theta and sigma, null where theta is null; clipped to 1e10, NaN as 0."""
    m, o = MODELS[model], options or FitOptions()
    full = np.concatenate([np.array([r[1:5] for r in rows], float)] * m.times)
    keep = [c for c in fitted.columns if c not in ("signal", "f")]
    up = np.triu_indices(m.n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pdf["theta"].notna()
            if not found.all():
                yield pdf.loc[~found, keep].assign(crlb=None)
            pdf = pdf[found]
            if not len(pdf):
                continue
            theta, sigma = np.stack(pdf["theta"].to_numpy()).astype(float), pdf["sigma"].to_numpy(float)[:, None]
            f = np.stack(pdf["f"].to_numpy()).astype(float) if "f" in pdf else np.zeros((len(pdf), max(6, m.n_fields)))
            a = m.signal(theta, full, f, o)[:, : len(full)]
            j = jacobian(m, theta, full, f, o)[:, : len(full)]
            w = (rice_information(np.abs(a) / sigma) if rice else 1) / sigma**2 * np.ones_like(a)
            info = weighted_square(j, w)
            scale = 1 / np.sqrt(np.maximum(np.einsum("vii->vi", info), 1e-300))
            inv = np.linalg.pinv(info * scale[:, :, None] * scale[:, None, :], hermitian=True) * scale[:, :, None] * scale[:, None, :]
            out = pdf[keep].copy()
            out["crlb"] = list(np.clip(np.nan_to_num(inv, nan=0.0), -1e10, 1e10)[:, up[0], up[1]].tolist())
            yield out

    types = dict(fitted.dtypes)
    return fitted.mapInPandas(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], "crlb array<double>"]))


def check_jacobian(dwi_theta: DataFrame, rows: list[tuple], model: str, options: FitOptions | None = None, step: float = 1e-6) -> DataFrame:
    """Largest difference of the Jacobian to central differences, for each parameter."""
    m, o = MODELS[model], options or FitOptions()
    full = np.concatenate([np.array([r[1:5] for r in rows], float)] * m.times)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            t = np.stack(pdf["theta"].to_numpy()).astype(float)
            f = np.stack(pdf["f"].to_numpy()).astype(float) if "f" in pdf else np.zeros((len(t), max(6, m.n_fields)))
            j = jacobian(m, t, full, f, o)
            for k in range(m.n):
                e = np.zeros(m.n)
                e[k] = step
                d = (m.signal(t + e, full, f, o) - m.signal(t - e, full, f, o)) / (2 * step)
                yield pd.DataFrame({"parameter": [k], "difference": [float(np.abs(d - j[:, :, k]).max())]})

    return dwi_theta.mapInPandas(run, "parameter int, difference double").groupBy("parameter").agg(F.max("difference").alias("difference"))


def simulate(theta: DataFrame, rows: list[tuple], model: str, options: FitOptions | None = None) -> DataFrame:
    """Noise-free signal of each voxel's theta (and f): all columns, then signal; pseudo-data are left out."""
    m, o = MODELS[model], options or FitOptions()
    full = np.concatenate([np.array([r[1:5] for r in rows], float)] * m.times)
    n = len(full) * (2 if model == "complex_decay" else 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                f = np.stack(pdf["f"].to_numpy()).astype(float) if "f" in pdf else np.zeros((len(pdf), max(6, m.n_fields)))
                yield pdf.assign(signal=list(m.signal(np.stack(pdf["theta"].to_numpy()).astype(float), full, f, o)[:, :n]))

    return spread(theta).mapInPandas(run, ", ".join([*[f"`{c}` {k}" for c, k in theta.dtypes], "signal array<double>"]))


def leverage(fitted: DataFrame, rows: list[tuple], model: str, rice: bool = True, options: FitOptions | None = None) -> DataFrame:
    """How far each datum draws its own prediction (column leverage, an array): 0 not at all, 1 all the way.

    fitted has signal, theta at an optimum, sigma (and f). The implicit
    function of the optimum gives the change of theta with a datum from the
    second derivatives of the likelihood; those of the model are left out, as
    in scoring. Pseudo-data count in the curvature and have no leverage of
    their own. Null where theta is null.
    """
    m, o = MODELS[model], options or FitOptions()
    full = np.concatenate([np.array([r[1:5] for r in rows], float)] * m.times)
    n = len(full)
    keep = [c for c in fitted.columns if c not in ("signal", "f", "leverage")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pdf["theta"].notna()
            if not found.all():
                yield pdf.loc[~found, keep].assign(leverage=None)
            pdf = pdf[found]
            if not len(pdf):
                continue
            data, f = _batch(pdf, m)
            theta, sigma = np.stack(pdf["theta"].to_numpy()).astype(float), pdf["sigma"].to_numpy(float)[:, None]
            a, j = m.signal(theta, full, f, o), jacobian(m, theta, full, f, o)
            bend, mixed = np.full(a.shape, 1 / o.prior_noise**2), 1 / sigma**2 + np.zeros((len(a), n))
            bend[:, :n] = mixed
            if rice:
                z = data[:, :n] * np.abs(a[:, :n]) / sigma**2
                ratio = bessel_ratio(z)[1]
                turn = 1 - np.where(z > 1e-6, ratio / np.maximum(z, 1e-300), 0.5) - ratio * ratio
                mixed = np.where(a[:, :n] < 0, -1, 1) * (ratio + z * turn) / sigma**2
                bend[:, :n] = -log_rice_logsigma(data[:, :n], a[:, :n], np.log(sigma))[3]
            h = weighted_square(j, bend)
            scale = 1 / np.sqrt(np.maximum(np.abs(np.einsum("vii->vi", h)), 1e-300))
            inv = np.linalg.pinv(h * scale[:, :, None] * scale[:, None, :], hermitian=True) * scale[:, :, None] * scale[:, None, :]
            draw = np.einsum("vmi,vij,vmj->vm", j[:, :n], inv, j[:, :n]) * mixed
            yield pdf[keep].assign(leverage=list(draw.tolist()))

    types = dict(fitted.dtypes)
    return fitted.mapInPandas(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], "leverage array<double>"]))

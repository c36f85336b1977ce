"""Starts of a fit: fractions by non-negative least squares, and global candidates ranked without their scale parameters.

Everything works on an Arrow batch of voxels at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.functions.columns import halton
from voxelspark.plans.models import FitOptions, Model, starts

AXES = ("x", "y", "z")


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """x >= 0 that minimises |a x - b| for each voxel: a (voxels, data, columns), b (voxels, data).

    Active sets of all voxels change together: a voxel whose gradient is
    positive somewhere frees the column where it is largest; a free column
    that would become negative goes back to zero at the point where it gets
    there. Voxels that are done are left out of further rounds.
    """
    size = np.sqrt((a * a).sum(1))
    scale = np.where(size > 0, size, 1.0)
    a = a / scale[:, None, :]
    return nnls_normal(np.einsum("vmi,vmj->vij", a, a), np.einsum("vmi,vm->vi", a, b), tolerance) / scale


def nnls_normal(g: np.ndarray, c: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """x >= 0 that minimises x g x / 2 - c x for each voxel, g with a diagonal about 1; see nnls."""
    n = c.shape[1]
    x, free = np.zeros(c.shape), np.zeros(c.shape, bool)
    limit, eye = tolerance * np.maximum(np.abs(c).max(1), 1e-300), np.eye(n)
    open_ = np.arange(len(c))
    for _ in range(3 * n):
        slope = c[open_] - np.einsum("vij,vj->vi", g[open_], x[open_])
        slope = np.where(free[open_], -np.inf, slope)
        j = slope.argmax(1)
        more = slope[np.arange(len(j)), j] > limit[open_]
        open_, j = open_[more], j[more]
        if not len(open_):
            break
        free[open_, j] = True
        held = open_
        for _ in range(n + 1):
            f = free[held]
            both = f[:, :, None] & f[:, None, :]
            s = np.linalg.solve(np.where(both, g[held], 0) + eye * np.where(f, 1e-14, 1.0)[:, None, :], np.where(f, c[held], 0)[..., None])[..., 0]
            bad = f & (s <= 0)
            fine = ~bad.any(1)
            x[held[fine]] = s[fine]
            held, s, bad = held[~fine], s[~fine], bad[~fine]
            if not len(held):
                break
            old = x[held]
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(bad, old / (old - s), np.inf)
            step = np.where(np.isnan(step), 0, step).min(1)
            old = old + step[:, None] * (s - old)
            gone = bad & (old <= 1e-15 * np.maximum(np.abs(old).max(1, keepdims=True), 1))
            free[held] &= ~gone
            x[held] = np.where(free[held], np.maximum(old, 0), 0)
    return x


def _polar(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.arccos(np.clip(u[:, 2], -1, 1)), np.arctan2(u[:, 1], u[:, 0])


def _eigen(dt: np.ndarray, o: FitOptions) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues within (1e-5, d_max), descending, and their vectors (rows)."""
    full = np.nan_to_num(dt[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]], posinf=0, neginf=0).reshape(-1, 3, 3)
    w, v = np.linalg.eigh(full)
    return np.clip(w[:, ::-1], 1e-5, o.d_max), v[:, :, ::-1].transpose(0, 2, 1)


def _diffusivity(w: np.ndarray, o: FitOptions) -> np.ndarray:
    """Along the sticks, as a share of d_max."""
    return np.clip((w[:, 0] + w[:, 1] - w[:, 2]) / o.d_max, 1e-2, 0.99)


def stick_fractions(directions: list[np.ndarray], c3: np.ndarray, data: np.ndarray, protocol: np.ndarray, o: FitOptions) -> np.ndarray:
    """Shares of the sticks and of the ball (last column): at least a hundredth of the signal each, and 1 together."""
    d = (c3 * o.d_max)[:, None]
    b, g = protocol[:, 0], protocol[:, 1:]
    columns = [np.exp(-d * b * (v @ g.T) ** 2) for v in directions] + [np.exp(-d * b)]
    x = np.maximum(nnls(np.stack(columns, 2), data), 0.01)
    return x / x.sum(1, keepdims=True)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def stick_starts(model: Model, data: np.ndarray, protocol: np.ndarray, dts: list[np.ndarray], s0: np.ndarray, fields: np.ndarray, o: FitOptions) -> list[np.ndarray]:
    """Candidate starts of the ball-and-stick models; directions come from the fields where the model has them."""
    eigen = [_eigen(dt, o) for dt in dts]
    scale = np.maximum(s0, 1e-300)
    own = [data[:, k * len(protocol) : (k + 1) * len(protocol)] / scale[:, [k]] for k in range(model.times)]
    (w, v), one = eigen[0], np.ones(len(data))
    if model.name == "balland1stick":
        c3, angles = _diffusivity(w, o), _polar(v[:, 0])
        x = stick_fractions([v[:, 0]], c3, own[0], protocol, o)
        return [np.stack([x[:, 1], c3, *angles, s0[:, 0]], 1), np.stack([one / 2, one / 2, *angles, s0[:, 0]], 1)]
    w, v = eigen[-1 if model.times > 1 else 0]  # with several time points the last one tells the directions
    flat = np.clip((w[:, 1] - w[:, 2]) / np.maximum(w[:, 0] - w[:, 2], 1e-12), 0.02, 0.98)[:, None]
    pairs = [(_unit(v[:, 0] + flat * v[:, 1]), _unit(v[:, 0] - flat * v[:, 1])), (v[:, 0], v[:, 1])]
    given = (np.abs(fields[:, :3]).sum(1) > 0) & (np.abs(fields[:, 3:6]).sum(1) > 0) if model.n_fields else np.zeros(len(data), bool)
    if given.any():  # both starts of a voxel with fields are along them
        along = _unit(fields[:, :3]), _unit(fields[:, 3:6])
        pairs = [tuple(np.where(given[:, None], f, e) for f, e in zip(along, pair)) for pair in pairs[: 1 if given.all() else 2]]
    out = []
    for v1, v2 in pairs:
        each = []
        for k in range(model.times):
            c3 = _diffusivity(eigen[k][0], o)
            x = stick_fractions([v1, v2], c3, own[k], protocol, o)
            each.append([x[:, 2], x[:, 0] / (1 - x[:, 2]), c3, s0[:, k]])
        angles = [*_polar(v1), *_polar(v2)]
        if model.times == 1:
            out.append(np.stack([*each[0][:3], *angles, each[0][3]], 1))
        else:
            out.append(np.stack([*(x for e in each for x in e), *angles], 1))
    return out


def candidates(model: Model, data: np.ndarray, protocol: np.ndarray, operator: np.ndarray, fields: np.ndarray, o: FitOptions) -> list[np.ndarray]:
    """Computed starts of any built-in model; data (pseudo-data may follow) are scaled, protocol is that of one time point."""
    n = len(protocol)
    own = [data[:, k * n : (k + 1) * n] for k in range(model.times)]
    dts = [np.log(np.maximum(np.maximum(d, d.mean(1, keepdims=True) / 100), 1e-300)) @ operator.T for d in own]
    zero = protocol[:, 0] == 0
    s0 = np.stack([d[:, zero].mean(1) if zero.any() else np.exp(t[:, 6]) for d, t in zip(own, dts)], 1)
    if "stick" in model.name:
        return stick_starts(model, data, protocol, dts, s0, fields, o)
    return starts(model, dts[0], s0, o)


# global candidates


def start_table(spark: SparkSession, ranges: list[tuple[float, float]], n: int, given: list[list[float]] = (), first: int = 1) -> DataFrame:
    """Rows (start, theta): the given vectors, then n low-discrepancy points of the box `ranges` (one base, a prime, for each parameter)."""
    primes = [p for p in range(2, 20 * len(ranges) + 20) if all(p % q for q in range(2, int(p**0.5) + 1))]
    at: Column = F.col("id")
    point = F.array(*[halton(at, p) * (hi - lo) + lo for p, (lo, hi) in zip(primes, ranges)])
    points = spark.range(first, first + n).select((at - first + len(given)).cast("int").alias("start"), point.alias("theta"))
    if not given:
        return points
    return spark.createDataFrame([(i, [float(x) for x in t]) for i, t in enumerate(given)], "start int, theta array<double>").unionByName(points)


def _basis(model: Model, table: np.ndarray, linear: tuple[int, ...], protocol: np.ndarray, fields: np.ndarray, o: FitOptions) -> tuple[np.ndarray, np.ndarray]:
    """Affine form of the signal in its scale parameters: the constant part (rows, data) and a column for each (rows, data, scales)."""
    t = table.copy()
    t[:, list(linear)] = 0
    constant = model.signal(t, protocol, fields, o)
    columns = []
    for k in linear:
        one = t.copy()
        one[:, k] = 1
        columns.append(model.signal(one, protocol, fields, o) - constant)
    return constant, np.stack(columns, 2)


def rank_starts(model: Model, table: np.ndarray, data: np.ndarray, protocol: np.ndarray, fields: np.ndarray, linear: tuple[int, ...], keep: int, o: FitOptions, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `keep` best starts of each voxel with their best scale parameters.

    The scale parameters are taken out by a QR factorisation of their columns:
    what is left of a voxel's data is |y|^2 - |Q' y|^2, so starts are ranked
    by the objective at their best scales and only the kept ones are solved
    for. A model without fields has one factorisation for each start, whatever
    the voxel. Ties keep the earlier start. Returns theta (voxels, keep,
    parameters), the reduced objective and the numbers of the starts.
    """
    keep, n = min(keep, len(table)), len(data)
    least, number = np.full((n, keep), np.inf), np.zeros((n, keep), int)
    theta = np.zeros((n, keep, model.n))
    if not model.n_fields:
        constant, columns = _basis(model, table, linear, protocol, np.zeros((len(table), 6)), o)
        q, r = np.linalg.qr(columns)
        moved, size = np.einsum("kml,km->kl", q, constant), (constant * constant).sum(1)
        rows = max(1, step // max(1, q.shape[0] * q.shape[2]))
        for lo in range(0, n, rows):
            y = data[lo : lo + rows]
            dot = (y @ q.transpose(1, 0, 2).reshape(q.shape[1], -1)).reshape(len(y), len(table), -1) - moved
            left = (y * y).sum(1)[:, None] - 2 * y @ constant.T + size - (dot * dot).sum(2)
            best = np.argsort(left, axis=1, kind="stable")[:, :keep]
            own = np.arange(len(y))[:, None]
            scales = np.linalg.solve(r[best] + 1e-300 * np.eye(r.shape[2]), dot[own, best][..., None])[..., 0]
            least[lo : lo + rows], number[lo : lo + rows] = left[own, best], best
            theta[lo : lo + rows] = table[best]
            theta[lo : lo + rows, :, list(linear)] = scales
        return theta, least, number
    for k in range(len(table)):
        constant, columns = _basis(model, np.repeat(table[k : k + 1], n, 0), linear, protocol, fields, o)
        q, r = np.linalg.qr(columns)
        y = data - constant
        dot = np.einsum("vml,vm->vl", q, y)
        left = (y * y).sum(1) - (dot * dot).sum(1)
        one = np.repeat(table[k : k + 1], n, 0)
        one[:, list(linear)] = np.linalg.solve(r + 1e-300 * np.eye(r.shape[2]), dot[..., None])[..., 0]
        all_left, all_number = np.column_stack([least, left]), np.column_stack([number, np.full(n, k)])
        best = np.argsort(all_left, axis=1, kind="stable")[:, :keep]
        own = np.arange(n)[:, None]
        theta = np.concatenate([theta, one[:, None, :]], axis=1)[own, best]
        least, number = all_left[own, best], all_number[own, best]
    return theta, least, number


def with_initialisation(dwi: DataFrame, theta0: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Voxels with a given start (column theta0, in the units of the signal); null where theta0 has none."""
    return dwi.join(theta0.select(*key, F.col("theta").alias("theta0")), list(key), "left")


def with_neighbour_starts(dwi: DataFrame, fitted: DataFrame, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Voxels with the parameters of their six neighbours in `fitted` (column more, an array of arrays; empty without any).

    Each fitted voxel is sent to its neighbours' places and grouped there: one
    shuffle on the place, six rows a voxel at most.
    """
    moves = F.array(*[F.struct(*[F.lit(s if a == b else 0).alias(f"d{b}") for b in AXES]) for a in AXES for s in (-1, 1)])
    sent = fitted.where("theta is not null").select(*by, *AXES, "theta", F.explode(moves).alias("_d"))
    at = [(F.col(a) + F.col(f"_d.d{a}")).cast("int").alias(a) for a in AXES]
    near = sent.select(*by, *at, F.struct(*[F.col(f"_d.d{a}") for a in AXES], "theta").alias("_t"))
    near = near.groupBy(*by, *AXES).agg(F.sort_array(F.collect_list("_t")).alias("_t")).select(*by, *AXES, F.transform("_t", lambda t: t["theta"]).alias("more"))
    return dwi.join(near, [*by, *AXES], "left").withColumn("more", F.coalesce("more", F.array().cast("array<array<double>>")))


def given_starts(pdf: pd.DataFrame, model: Model, scale: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(voxels, theta) of the columns theta0 and more, with S0 on the scale of the solve."""
    lists = []
    if "theta0" in pdf:
        lists.append([[t] if t is not None else [] for t in pdf["theta0"]])
    if "more" in pdf:
        lists.append([list(t) if t is not None else [] for t in pdf["more"]])
    for column in lists:
        for k in range(max(map(len, column), default=0)):
            at = np.array([i for i, t in enumerate(column) if len(t) > k])
            theta = np.stack([np.asarray(column[i][k], float) for i in at])
            theta[:, list(model.s0)] /= scale[at, None]
            yield at, theta

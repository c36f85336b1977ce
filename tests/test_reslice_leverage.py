"""Reslicing against a direct loop, leverage against refits with one datum moved."""

import itertools
import math

import numpy as np
import pytest

from voxelspark.operators.reslice import reslice
from voxelspark.plans import fit as P
from voxelspark.plans.fixtures import protocol_rows
from voxelspark.plans.models import MODELS, FitOptions

O = FitOptions()
ROWS = protocol_rows((1000.0, 2000.0))
P4 = np.array([r[1:] for r in ROWS])


def direct(cube, affine, size, method, background=None):
    dims = np.array(cube.shape)
    m, t = affine[:, :3], affine[:, 3]
    corners = np.array([m @ (np.array(c) * (dims - 1)) + t for c in itertools.product((0, 1), repeat=3)])
    away = np.vectorize(lambda v: math.copysign(math.floor(abs(v) + 0.5), v))
    lo, hi = away(corners.min(0)), away(corners.max(0))
    new = np.ceil((hi - lo) / size + 1).astype(int)
    out = {}
    for at in itertools.product(*map(range, new)):
        p = np.linalg.inv(m) @ (lo + np.array(at) * size - t)
        if not ((p > -0.05) & (p < dims - 1 + 0.05)).all():
            out[at] = (cube[0, 0, 0] + cube[-1, -1, -1]) / 2 if background is None else background
        elif method == "nearest":
            out[at] = cube[tuple(np.clip(away(p), 0, dims - 1).astype(int))]
        else:
            out[at] = 0.0
            for c in itertools.product((0, 1), repeat=3):
                w = np.prod([(p[i] - math.floor(p[i])) if c[i] else 1 - (p[i] - math.floor(p[i])) for i in range(3)])
                q = [0 if math.floor(p[i]) < 0 else min(math.floor(p[i]) + c[i], dims[i] - 1) for i in range(3)]
                out[at] += w * cube[tuple(q)]
    return out


@pytest.mark.parametrize("method,background", [("trilinear", None), ("trilinear", -1.0), ("nearest", 7.0)])
def test_reslice(spark, method, background):
    rng = np.random.default_rng(1)
    cubes = {1: rng.normal(size=(6, 5, 4)), 2: rng.normal(size=(3, 7, 2))}
    turn = np.array([[0.9, -0.3, 0.1], [0.3, 0.95, -0.2], [-0.05, 0.2, 1.1]])
    affines = {1: np.column_stack([turn * 2, [3.3, -4.6, 0.2]]), 2: np.column_stack([np.diag([-2.0, 1.0, 3.0]), [0.0, 5.0, -2.0]])}
    df = spark.createDataFrame([(s, *map(int, p), float(c[p])) for s, c in cubes.items() for p in np.ndindex(c.shape)] + [(3, 0, 0, 0, 1.0)], "scan_id int, x int, y int, z int, v double")
    scans = spark.createDataFrame([(s, a.ravel().tolist(), list(cubes[s].shape)) for s, a in affines.items()], "scan_id int, affine array<double>, dims array<int>")
    got = {(r.scan_id, r.x, r.y, r.z): r.v for r in reslice(df, scans, (1.5, 2.0, 1.0), method, background, tile=3).collect()}
    want = {(s, *p): v for s in cubes for p, v in direct(cubes[s], affines[s], np.array([1.5, 2.0, 1.0]), method, background).items()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], atol=1e-9) for k in want)


def test_reslice_of_gaps_and_nothing(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 2.0), (1, 1, 1, 1, float("nan")), (1, 1, 0, 0, None)], "scan_id int, x int, y int, z int, v double")
    scans = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0], [2, 2, 2])], "scan_id int, affine array<double>, dims array<int>")
    got = {(r.x, r.y, r.z): r.v for r in reslice(df, scans, (1.0, 1.0, 1.0)).collect()}
    assert len(got) == 8 and got.pop((0, 0, 0)) == 2.0 and set(got.values()) == {0.0}
    assert reslice(df.limit(0), scans.limit(0), (1.0, 1.0, 1.0)).count() == 0
    with pytest.raises(ValueError):
        reslice(df, scans, (1.0, 1.0, 1.0), "cubic")


def test_leverage_is_what_refits_do(spark):
    m = MODELS["balland1stick"]
    rng = np.random.default_rng(2)
    t = np.column_stack([rng.uniform(0.3, 0.6, 6), rng.uniform(0.3, 0.6, 6), rng.uniform(0.4, 1.2, 6), rng.uniform(0.4, 1.2, 6), rng.uniform(80, 120, 6)])
    y = m.signal(t, P4, None, O)
    y = np.abs(y + rng.normal(size=y.shape) + 1j * rng.normal(size=y.shape))
    f, sigma = np.zeros((6, 6)), np.ones(6)
    solve = lambda data: P.maximise_rice(m, t, data, sigma, P4, f, O, iterations=200)[0]
    best = solve(y)
    df = spark.createDataFrame([(i, a.tolist(), b.tolist(), 1.0) for i, (a, b) in enumerate(zip(y, best))] + [(9, y[0].tolist(), None, 1.0)], "vox int, signal array<double>, theta array<double>, sigma double")
    rows = {r.vox: r.leverage for r in P.leverage(df, ROWS, "balland1stick").collect()}
    assert rows[9] is None
    got = np.array([rows[i] for i in range(6)])
    assert (got > 0).all() and np.allclose(got.sum(1), 5, atol=0.3)
    for k in (0, 3, 20, 40):
        up, down = y.copy(), y.copy()
        up[:, k] += 0.05
        down[:, k] -= 0.05
        moved = (m.signal(solve(up), P4, f, O)[:, k] - m.signal(solve(down), P4, f, O)[:, k]) / 0.1
        assert np.allclose(moved, got[:, k], atol=0.03)

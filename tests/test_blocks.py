"""Block sweeps: the coupled optimum of a whole grid, and the fit of each voxel by itself where nothing couples them."""

import itertools

import numpy as np
import pytest

from voxelspark.operators import blocks as B
from voxelspark.plans import fit as P
from voxelspark.plans import rice as R
from voxelspark.plans.fixtures import protocol_rows
from voxelspark.plans.models import MODELS, FitOptions

O = FitOptions()
ROWS = protocol_rows((1000.0, 2000.0))
P4 = np.array([r[1:] for r in ROWS])
GRID = list(itertools.product(range(5), range(3), range(2)))


def grid(spark, values, scans=(1,)):
    return spark.createDataFrame([(s, *map(int, p), float(v) * s) for s in scans for p, v in zip(GRID, values)], "scan_id int, x int, y int, z int, v double")


def test_laplacian_is_the_penalty_s():
    l = B.laplacian(np.array(GRID))  # noqa: E741
    v = np.random.default_rng(1).normal(size=len(GRID))
    for i, p in enumerate(GRID):
        want = 0.0
        for a, step in itertools.product(range(3), (-1, 1)):
            q = list(p)
            q[a] += step
            want += v[GRID.index(tuple(q))] - v[i] if tuple(q) in GRID else 0
        assert np.isclose((l @ v)[i], want)


def test_smooth_field_is_the_dense_solution(spark):
    v = np.random.default_rng(2).normal(size=len(GRID))
    want = np.linalg.solve(np.eye(len(GRID)) - 0.3 * B.laplacian(np.array(GRID)), v)
    got = {(r.scan_id, r.x, r.y, r.z): r.v for r in B.smooth_field(grid(spark, v, (1, 2)), 0.3, (3, 2, 2)).collect()}
    assert len(got) == 2 * len(GRID)
    assert all(np.isclose(got[s, *p], want[i] * s, atol=1e-8) for s in (1, 2) for i, p in enumerate(GRID))
    holes = grid(spark, v).where("not (x = 2 and y = 1)").selectExpr("scan_id", "x - 7 as x", "y", "z", "v")
    at = np.array([p for p in GRID if p[:2] != (2, 1)])
    want = np.linalg.solve(np.eye(len(at)) - 0.3 * B.laplacian(at), v[[GRID.index(tuple(p)) for p in at.tolist()]])
    got = {(r.x + 7, r.y, r.z): r.v for r in B.smooth_field(holes, 0.3, (2, 2, 2)).collect()}
    assert all(np.isclose(got[tuple(p)], w, atol=1e-8) for p, w in zip(at.tolist(), want))
    assert B.smooth_field(holes.limit(0), 0.3).count() == 0


def test_failing_blocks_keep_their_values_and_wide_halos_are_refused(spark):
    df = grid(spark, np.ones(len(GRID)))

    def solve(block, own):
        if block["x"][own].min() >= 2:
            raise np.linalg.LinAlgError
        return block[own].assign(v=2.0)

    out = next(B.block_sweep(df, solve, (2, 2, 2), 1))
    assert {(r.x >= 2, r.v) for r in out.collect()} == {(False, 2.0), (True, 1.0)} and out.count() == len(GRID)
    with pytest.raises(ValueError):
        next(B.block_sweep(df, solve, (2, 2, 2), 3))


def noisy(spark, seed=4):
    rng = np.random.default_rng(seed)
    t = np.column_stack([rng.uniform(0.3, 0.6, len(GRID)), rng.uniform(0.3, 0.6, len(GRID)), rng.uniform(0.4, 1.2, len(GRID)), rng.uniform(0.4, 1.2, len(GRID)), rng.uniform(80, 120, len(GRID))])
    a = MODELS["balland1stick"].signal(t, P4, None, O)
    y = np.abs(a + 6 * (rng.normal(size=a.shape) + 1j * rng.normal(size=a.shape)))
    df = spark.createDataFrame([(1, *p, v.tolist()) for p, v in zip(GRID, y)], "scan_id int, x int, y int, z int, signal array<double>")
    fits = P.fit_lsq(df, ROWS, "balland1stick").join(df, ["scan_id", "x", "y", "z"]).selectExpr("*", "9D as sigma")
    return y, fits


def field(df):
    rows = {(r.x, r.y, r.z): r for r in df.collect()}
    return np.array([rows[p].theta for p in GRID]), np.array([rows[p].sigma for p in GRID])


def objective(y, theta, sigma, weight):
    a = MODELS["balland1stick"].signal(theta, P4, None, O)
    return weight / 2 * ((B.laplacian(np.array(GRID)) @ sigma) ** 2).sum() - R.rice_loglik(y, a, sigma[:, None]).sum()


def test_without_weight_each_voxel_is_by_itself(spark):
    y, fits = noisy(spark)
    out, history = P.regularise_noise(fits, ROWS, "balland1stick", 0.0, (3, 3, 3), sweeps=3, steps=25)
    theta, sigma = field(out)
    want_theta, want_sigma = field(P.fit_ml(fits, ROWS, "balland1stick", refine_noise=True))
    assert np.isclose(history[-1], objective(y, want_theta, want_sigma, 0), atol=2e-2)
    assert np.allclose(sigma, want_sigma, rtol=1e-3) and np.isclose(history[-1], objective(y, theta, sigma, 0))


def test_objective_falls_to_that_of_one_solve_of_the_whole_grid(spark):
    y, fits = noisy(spark)
    weight = 0.05
    out, history = P.regularise_noise(fits, ROWS, "balland1stick", weight, (3, 3, 3), sweeps=12, steps=20, tolerance=1e-9)
    theta, sigma = field(out)
    assert all(b <= a + 1e-9 * abs(a) for a, b in zip(history, history[1:])) and history[0] - history[-1] > 10
    assert np.isclose(history[-1], objective(y, theta, sigma, weight))
    whole, single = P.regularise_noise(fits, ROWS, "balland1stick", weight, (99, 99, 99), sweeps=4, steps=60, tolerance=0)
    assert abs(single[-1] - history[-1]) < 0.02
    assert np.allclose(field(whole)[1], sigma, rtol=5e-3)
    e = 1e-4
    for i in range(0, len(GRID), 7):  # stationary in the noise of a voxel
        up, down = sigma.copy(), sigma.copy()
        up[i] += e
        down[i] -= e
        assert abs(objective(y, theta, up, weight) - objective(y, theta, down, weight)) / (2 * e) < 0.05
    assert np.std(sigma) < 0.9 * np.std(field(P.fit_ml(fits, ROWS, "balland1stick", refine_noise=True))[1])


def test_block_solution_is_shared_by_blocks_of_one_shape():
    """One map for all blocks of a shape; it gives the solution of the block's equations with the halo held."""
    at = np.array([(x, y, z) for x in range(3) for y in range(2) for z in range(4) if (x, y, z) != (1, 1, 2)], np.int64)
    own = at[:, 2] < 3
    inner, outer = B._block_solution(at.tobytes(), own.tobytes(), 0.3)
    assert B._block_solution(at.copy().tobytes(), own.copy().tobytes(), 0.3)[0] is inner
    u, v = np.random.default_rng(1).normal(size=(2, len(at)))
    m = -0.3 * B.laplacian(at)
    want = np.linalg.solve(m[np.ix_(own, own)] + np.eye(own.sum()), v[own] - m[np.ix_(own, ~own)] @ u[~own])
    assert np.abs(inner @ v[own] + outer @ u[~own] - want).max() < 1e-12


def test_sweep_with_null_groups(spark):
    """Rows whose group is null are a group of their own, also where another is called like nothing; blocks at 2 and 3 see neighbours that have moved."""
    rows = [(g, x, 0, 0, float(i)) for i, g in enumerate([None, "", "null", "a"]) for x in range(5)]
    df = spark.createDataFrame(rows, "scan_id string, x int, y int, z int, v double")

    def solve(block, own):
        return block[own].assign(v=block.loc[own, "v"] + block["v"].nunique() / 10)

    out = next(B.block_sweep(df, solve, (2, 2, 2), 1))
    assert sorted((r.scan_id or str(r.scan_id), r.x, round(r.v, 6)) for r in out.collect()) == sorted((g or str(g), x, round(v + (0.2 if x in (2, 3) else 0.1), 6)) for g, x, _, _, v in rows)


def test_a_fit_is_worked_out_once_for_its_objective_and_sweeps(spark):
    _, fits = noisy(spark)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    P.regularise_noise(fits.mapInPandas(count, fits.schema), ROWS, "balland1stick", 0.05, (3, 3, 3), sweeps=1, steps=1)
    assert seen.value == len(GRID)

"""Non-negative least squares, ranked global starts, given and neighbours' starts."""

import itertools

import numpy as np
import pytest

from pyspark.sql import functions as F

from voxelspark.plans import fit as P
from voxelspark.plans import starts as T
from voxelspark.plans.fixtures import protocol_rows
from voxelspark.plans.models import MODELS, FitOptions, Model, register

O = FitOptions()
ROWS = protocol_rows((1000.0, 2000.0))
P4 = np.array([r[1:] for r in ROWS])


def enumerated(a, b):
    """All active sets of one voxel: the feasible one with the smallest residual."""
    best, x = (b @ b), np.zeros(a.shape[1])
    for k in range(1, a.shape[1] + 1):
        for free in itertools.combinations(range(a.shape[1]), k):
            s = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            r = ((a[:, free] @ s - b) ** 2).sum()
            if (s >= -1e-12).all() and r < best - 1e-12:
                best, x = r, np.zeros(a.shape[1])
                x[list(free)] = s
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_nnls_is_the_best_active_set(n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(200, 9, n)), rng.normal(size=(200, 9))
    a[:20] = np.abs(a[:20])
    b[:10] = np.abs(b[:10])
    x = T.nnls(a, b)
    want = np.stack([enumerated(p, q) for p, q in zip(a, b)])
    assert (x >= 0).all() and np.allclose(x, want, atol=1e-8)
    slope = np.einsum("vmi,vm->vi", a, b - np.einsum("vmi,vi->vm", a, x))
    assert (slope < 1e-7).all() and (np.abs(slope[x > 0]) < 1e-7).all()


def test_nnls_of_equal_and_empty_columns():
    a = np.ones((3, 4, 3))
    a[1, :, 2] = 0
    b = np.array([[1.0, 2, 3, 4], [1, 2, 3, 4], [-1, -1, -1, -1]])
    x = T.nnls(a, b)
    assert np.allclose(x.sum(1)[[0, 2]], [2.5, 0]) and np.allclose(x[1, :2].sum(), 2.5) and (x >= 0).all()
    assert T.nnls(np.zeros((0, 4, 2)), np.zeros((0, 4))).shape == (0, 2)


def test_start_fractions_of_sticks_are_the_best_active_set():
    rng = np.random.default_rng(3)
    v = [T._unit(rng.normal(size=(50, 3))) for _ in range(2)]
    c3, data = rng.uniform(0.2, 0.8, 50), rng.uniform(0.1, 1, (50, len(P4)))
    got = T.stick_fractions(v, c3, data, P4, O)
    for i in range(50):
        d = c3[i] * O.d_max
        a = np.stack([np.exp(-d * P4[:, 0] * (P4[:, 1:] @ u[i]) ** 2) for u in v] + [np.exp(-d * P4[:, 0])], 1)
        x = np.maximum(enumerated(a, data[i]), 0.01)
        assert np.allclose(got[i], x / x.sum(), atol=1e-7)


def truth(n, seed=1):
    rng = np.random.default_rng(seed)
    m = MODELS["balland2sticks"]
    t = np.column_stack([rng.uniform(0.1, 0.4, n), rng.uniform(0.3, 0.7, n), rng.uniform(0.3, 0.7, n), rng.uniform(0.5, 1.0, n), rng.uniform(0.2, 1.0, n), rng.uniform(1.8, 2.5, n), rng.uniform(2.5, 3.0, n), rng.uniform(80, 120, n)])
    return m, t, m.signal(t, P4, np.zeros((n, 6)), O)


def test_iterations_fall_with_fitted_fractions():
    from voxelspark.operators.signals import log_linear_operator

    m, t, y = truth(200)
    f = np.zeros((200, 6))
    y = y / y.max(1, keepdims=True)
    first = T.candidates(m, y, P4, log_linear_operator(ROWS), f, O)[0]
    fixed = first.copy()
    fixed[:, :2] = 0.3, 0.5
    (_, r1, n1), (_, r2, n2) = (P.levenberg_marquardt(m, x, y, P4, f, O) for x in (first, fixed))
    assert n1.mean() < n2.mean() and np.median(r1) <= np.median(r2) + 1e-9


def test_ranking_takes_the_scales_out():
    m, t, y = truth(40)
    table = np.vstack([t[:, :], np.random.default_rng(2).uniform(0.1, 0.9, (60, 8))])
    table[:, 7] = 1.0
    theta, left, number = T.rank_starts(m, table, y, P4, np.zeros((40, 6)), (7,), 3, O, step=500)
    assert (number[:, 0] == np.arange(40)).all() and np.allclose(theta[:, 0], t) and (left[:, 0] < 1e-6 * (y * y).sum(1)).all()
    for i in (0, 7, 39):  # against the least squares of each start
        want = []
        for k in range(len(table)):
            a = m.signal(table[k : k + 1], P4, np.zeros((1, 6)), O)[0]
            want.append(((y[i] - a * (a @ y[i]) / (a @ a)) ** 2).sum())
        assert np.allclose(left[i], np.sort(want)[:3], atol=1e-6)


def test_ranking_with_fields_and_pseudo_data():
    """Pseudo-data do not follow the scale; ranks as those of each voxel's own factorisation."""
    m = MODELS["balland2sticks_orientationprior"]
    rng = np.random.default_rng(4)
    f = np.concatenate([T._unit(rng.normal(size=(6, 3))), T._unit(rng.normal(size=(6, 3)))], 1)
    table = rng.uniform(0.2, 0.8, (9, 8))
    y = np.concatenate([rng.uniform(0.1, 1, (6, len(P4))), np.zeros((6, 2))], 1)
    theta, left, number = T.rank_starts(m, table, y, P4, f, (7,), 4, O)
    for i in range(6):
        want = []
        for k in range(9):
            t = table[k : k + 1].copy()
            s = [((m.signal(np.where(np.arange(8) == 7, z, t), P4, f[i : i + 1], O)[0] - y[i]) ** 2).sum() for z in (0.0, 1.0, 2.0)]
            c = np.polyfit([0.0, 1.0, 2.0], s, 2)
            want.append(np.polyval(c, -c[1] / 2 / c[0]))
        assert np.allclose(left[i], np.sort(want)[:4]) and (np.array(want)[number[i]].round(9) == left[i].round(9)).all()
        assert np.allclose(((m.signal(theta[i], P4, np.repeat(f[i : i + 1], 4, 0), O) - y[i]) ** 2).sum(1), left[i])


def test_several_scales_at_once(spark):
    def two_decays(t, p, f, o):  # inside, so that it goes to the tasks by value
        return t[:, [0]] * np.exp(-p[:, 0] / 1000 * t[:, [1]]) + t[:, [2]] * np.exp(-p[:, 0] / 1000 * t[:, [3]])

    register(Model("two_decays", two_decays, 4, (), (), (0, 2)))
    rows = [(i, 250.0 * i, *r[2:]) for i, r in enumerate(ROWS[3:19])]
    t = np.array([[3.0, 0.3, 5.0, 4.0], [1.0, 0.1, 9.0, 2.0]])
    y = two_decays(t, np.array([r[1:] for r in rows]), None, O)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vox int, signal array<double>")
    table = T.start_table(spark, [(1.0, 1.0), (0.0, 1.0), (1.0, 1.0), (1.0, 6.0)], 200)
    for r in P.multi_start(df, rows, "two_decays", table, keep=4).collect():
        assert np.allclose(sorted(r.theta), sorted(t[r.vox]), rtol=1e-3) and r.start >= 0
    del MODELS["two_decays"]


def test_given_neighbours_and_table(spark):
    m, t, y = truth(27)
    places = list(itertools.product(range(3), repeat=3))
    rows = [(0, *p, v.tolist()) for p, v in zip(places, y)]
    dwi = spark.createDataFrame(rows, "scan_id int, x int, y int, z int, signal array<double>")
    bad = [0.9, 0.9, 0.9, 1.57, 0.0, 1.57, 0.0, 10.0]
    theta0 = spark.createDataFrame([(0, *p, bad) for p in places[:20]], "scan_id int, x int, y int, z int, theta array<double>")
    given = T.with_initialisation(dwi, theta0, ("scan_id", "x", "y", "z"))
    alone = {(r.x, r.y, r.z): r for r in P.fit_lsq(given, ROWS, "balland2sticks").collect()}
    assert [alone[p].start for p in places[:20]] == [-1] * 20 and all(alone[p].start >= 0 for p in places[20:])
    near = T.with_neighbour_starts(given, spark.createDataFrame([(0, *p, x.tolist()) for p, x in zip(places, t)], "scan_id int, x int, y int, z int, theta array<double>"))
    counts = {(r.x, r.y, r.z): r.n for r in near.select("x", "y", "z", F.size("more").alias("n")).collect()}
    assert counts[1, 1, 1] == 6 and counts[0, 0, 0] == 3 and counts[0, 1, 1] == 5
    table = T.start_table(spark, [(0.05, 0.6), (0.2, 0.8), (0.2, 0.8), (0, 3.14), (-3.14, 3.14), (0, 3.14), (-3.14, 3.14), (1, 1)], 300, given=[bad])
    found = {(r.x, r.y, r.z): r for r in P.multi_start(near, ROWS, "balland2sticks", table, keep=5, computed=True).collect()}
    good = [found[p].rss < 1e-3 for p in places]
    assert sum(good) >= 26 and sum(alone[p].rss > 1 for p in places[:20]) > 5
    assert {r.start for r in found.values()} - set(range(301)), "neighbours and computed starts take part"


def test_start_table_is_the_digit_reversal(spark):
    got = [tuple(round(v, 9) for v in r.theta) for r in T.start_table(spark, [(0.0, 1.0), (0.0, 9.0)], 4, given=[[7, 7]]).orderBy("start").collect()]
    assert got == [(7, 7), (0.5, 3), (0.25, 6), (0.75, 1), (0.125, 4)]


def test_no_rows_and_dead_voxels(spark):
    table = T.start_table(spark, [(0.1, 0.9)] * 2 + [(0.0, 3.0)] * 2 + [(1.0, 1.0)], 5)
    df = spark.createDataFrame([(1, [0.0] * len(ROWS)), (2, [float("nan")] * len(ROWS))], "vox int, signal array<double>")
    assert [r.theta for r in P.multi_start(df, ROWS, "balland1stick", table).collect()] == [None, None]
    assert P.multi_start(df.limit(0), ROWS, "balland1stick", table).count() == 0

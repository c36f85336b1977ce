"""Image types, constraints by their conditions of optimality, the prior, and the noise loop."""

import numpy as np
import pytest

from voxelspark.plans import general as G
from voxelspark.plans.models import MODELS, FitOptions

O = FitOptions()
ROWS = [(i, 0.1 * i, 0.0, 0.0, 0.0) for i in range(16)]
P4 = np.array([r[1:] for r in ROWS])
NONE = G.Constraints().rows(2)


def truth(model, n=50, seed=1):
    rng = np.random.default_rng(seed)
    t = {"exponential_decay": (rng.uniform(50, 100, n), rng.uniform(0.5, 2, n)), "linear_phase": (rng.uniform(-3, 3, n), rng.uniform(3, 8, n)), "complex_decay": (rng.uniform(50, 100, n), rng.uniform(0.5, 2, n), rng.uniform(-3, 3, n), rng.uniform(3, 8, n))}[model]
    t = np.column_stack(t)
    return t, MODELS[model].signal(t, P4, None, O)


def fit(model, kind, theta, y, sigma=1.0, limits=None, prior=None):
    n = MODELS[model].n
    return G.maximise(MODELS[model], kind, theta.copy(), y, np.full(len(y), sigma), P4, np.zeros((len(y), 6)), O, limits or G.Constraints().rows(n), prior)


@pytest.mark.parametrize("model,kind", [("exponential_decay", "real"), ("exponential_decay", "magnitude"), ("exponential_decay", "robust"), ("complex_decay", "complex"), ("linear_phase", "phase")])
def test_truth_of_each_type(model, kind):
    t, y = truth(model)
    if kind == "phase":
        y = np.angle(np.exp(1j * y))
    start = t * 1.05 + 0.02
    found = fit(model, kind, start, y, 0.02 if kind == "magnitude" else 1.0)[0]
    assert np.allclose(found, t, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("kind", sorted(G.LIKELIHOODS))
def test_slopes_are_those_of_the_values(kind):
    rng = np.random.default_rng(2)
    y, a, s, e = rng.uniform(0.1, 9, 200), rng.uniform(0.2, 9, 200), rng.uniform(0.5, 2, 200), 1e-6
    like = G.LIKELIHOODS[kind]
    assert np.allclose(like.slope(y, a, s), (like.value(y, a + e, s) - like.value(y, a - e, s)) / (2 * e), rtol=1e-5, atol=1e-6)
    assert (like.weight(y, a, s) > 0).all()


def test_outliers_hardly_move_a_robust_fit():
    t, y = truth("exponential_decay")
    y = y.copy()
    y[np.arange(50), np.arange(50) % 16] += 400
    robust, normal = (np.abs(fit("exponential_decay", k, t, y, 0.1)[0] / t - 1).max() for k in ("robust", "real"))
    assert robust < 0.01 < 0.3 < normal


def test_constraints_meet_the_conditions_of_optimality():
    """Inside the limits, and the slope of the objective is a non-negative combination of the limits that are met."""
    t, y = truth("exponential_decay", 200)
    c = G.Constraints(lower=(60.0, None), upper=(90.0, 1.6), a=((1.0, 30.0), (-1.0, -10.0)), b=(125.0, -75.0))
    a, b = c.rows(2)
    found, value, _ = fit("exponential_decay", "real", t, y, 2.0, (a, b))
    slack = b - found @ a.T
    assert (slack > -1e-7).all() and (slack < 1e-6).any(1).sum() > 50 and ((slack < 1e-6).sum(1) > 1).any()
    from voxelspark.plans.models import jacobian

    m = MODELS["exponential_decay"]
    g = np.einsum("vmi,vm->vi", jacobian(m, found, P4, None, O), y - m.signal(found, P4, None, O)) / 4
    for i in range(200):
        met = np.flatnonzero(slack[i] < 1e-6)
        best = np.zeros(2) if not len(met) else a[met].T @ G.nnls_normal((a[met] @ a[met].T + 1e-12 * np.eye(len(met)))[None], (a[met] @ g[i])[None])[0]
        assert np.abs(best - g[i]).max() < 1e-3 * max(1, np.abs(g[i]).max())
    free = ~(slack < 1e-6).any(1)
    assert np.allclose(found[free], t[free], rtol=1e-4)


def test_starts_outside_move_inside_and_wrong_constraints_are_refused():
    t, y = truth("exponential_decay", 5)
    a, b = G.Constraints(lower=(1.0, 0.1)).rows(2)
    found = fit("exponential_decay", "real", -t, y, 1.0, (a, b))[0]
    assert (found >= np.array([1.0, 0.1]) - 1e-9).all()
    for wrong in (G.Constraints(a=((1.0, 1.0),)), G.Constraints(a=((0.0, 0.0),), b=(1.0,))):
        with pytest.raises(ValueError):
            wrong.rows(2)


def test_prior_of_a_linear_model_is_the_weighted_mean():
    y = np.array([[4.0] * 16, [8.0] * 16])
    prior = np.array([2.0]), np.array([[0.25]])
    m = MODELS["constant"]
    found = G.maximise(m, "real", np.ones((2, 1)), y, np.full(2, 2.0), P4, np.zeros((2, 6)), O, G.Constraints().rows(1), prior)[0]
    assert np.allclose(found[:, 0], (y.mean(1) * 16 / 4 + 2.0 / 0.25) / (16 / 4 + 1 / 0.25), atol=1e-5)
    assert np.isclose(G.log_mvn_prior(np.array([[3.0]]), *prior)[0], -2.0)


def test_noise_loop_and_nulls(spark):
    t, _ = truth("exponential_decay", 300)
    t[:, 1] *= 0.3  # no signal falls to the noise level, where residuals of magnitudes are smaller
    y, rng = MODELS["exponential_decay"].signal(t, P4, None, O), np.random.default_rng(3)
    y = np.abs(y + 5 * (rng.normal(size=y.shape) + 1j * rng.normal(size=y.shape)))
    rows = [(i % 2, i, v.tolist(), (x * 1.3).tolist()) for i, (v, x) in enumerate(zip(y, t))]
    rows += [(0, 998, [1.0] * 16, None), (1, 999, [float("nan")] * 16, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "scan_id int, vox int, signal array<double>, theta array<double>")
    out = {r.vox: r for r in G.fit_general(df, ROWS, "exponential_decay", "magnitude").collect()}
    assert out[998].theta is None and out[999].theta is None and len(out) == 302
    assert all(0.8 < r.sigma / 5 < 1.25 for k, r in out.items() if k < 900)
    assert abs(np.median([out[i].theta[0] / t[i, 0] for i in range(300)]) - 1) < 0.02
    once = G.fit_general(df, ROWS, "exponential_decay", "real", sigma=5.0)
    assert {r.sigma for r in once.collect()} == {5.0}
    assert G.fit_general(df.limit(0), ROWS, "exponential_decay", "robust").count() == 0

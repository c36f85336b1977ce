"""Density, derivatives and information of the Rice distribution; noise estimated with the parameters; statistics and levels."""

import numpy as np
import pytest

from voxelspark.operators import signals as S
from voxelspark.plans import fit as P
from voxelspark.plans import rice as R
from voxelspark.plans.fixtures import protocol_rows
from voxelspark.plans.models import MODELS, FitOptions

O = FitOptions()
ROWS = protocol_rows((1000.0, 2000.0))
P4 = np.array([r[1:] for r in ROWS])


def test_derivatives_are_those_of_the_density():
    rng = np.random.default_rng(1)
    x, a, s = rng.uniform(0.05, 40, 500), rng.uniform(-30, 30, 500), rng.uniform(-1, 1.5, 500)
    value, of_a, of_s, aa, as_, ss = R.log_rice_logsigma(x, a, s)
    assert np.allclose(value, R.rice_loglik(x, a, np.exp(s)))
    e = 1e-6
    at = lambda da, ds: R.log_rice_logsigma(x, a + da, s + ds)
    for got, k, d in ((of_a, 0, (e, 0)), (of_s, 0, (0, e)), (aa, 1, (e, 0)), (as_, 1, (0, e)), (ss, 2, (0, e))):
        far = np.abs(a) > 1e-3
        want = (at(*d)[k] - at(-d[0], -d[1])[k]) / (2 * e)
        assert np.allclose(got[far], want[far], rtol=2e-5, atol=2e-4 * np.abs(want).max())


def test_information_table_against_quadrature():
    a = np.concatenate([np.linspace(0, 33, 700), [40.0, 100.0, 700.0]])
    want = R.information_by_quadrature(a, 900)
    got = np.stack(R.rice_information_joint(a))
    assert np.abs(got - want)[:, a < 33].max() < 1e-10 and np.abs(got - want).max() < 1e-8
    assert abs(R.rice_information(np.array([1e6]))[0] - 1) < 1e-9
    assert R.rice_information_joint(np.zeros((2, 3)))[2].shape == (2, 3)


def test_information_is_the_mean_of_second_derivatives():
    rng = np.random.default_rng(2)
    for a in (0.7, 2.0, 5.0):
        x = np.abs(a + rng.normal(size=400_000) + 1j * rng.normal(size=400_000))
        *_, aa, as_, ss = R.log_rice_logsigma(x, np.full_like(x, a), np.zeros_like(x))
        want = [v[0] for v in R.rice_information_joint(np.array([a]))]
        for got, w in zip((aa, as_, ss), want):
            assert abs(-got.mean() - w) < 5 * got.std() / np.sqrt(len(x))


def noisy(n=400, sigma=12.0, seed=3):
    rng = np.random.default_rng(seed)
    t = np.column_stack([rng.uniform(0.3, 0.6, n), rng.uniform(0.3, 0.6, n), rng.uniform(0.4, 1.2, n), rng.uniform(0.4, 1.2, n), rng.uniform(80, 120, n)])
    a = MODELS["balland1stick"].signal(t, P4, None, O)
    return t, np.abs(a + sigma * (rng.normal(size=a.shape) + 1j * rng.normal(size=a.shape)))


def test_noise_is_recovered_and_the_optimum_is_stationary(spark):
    t, y = noisy()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vox int, signal array<double>")
    fits = P.fit_lsq(df, ROWS, "balland1stick").join(df, "vox").selectExpr("*", "30D as sigma")
    got = sorted(P.fit_ml(fits, ROWS, "balland1stick", refine_noise=True).collect(), key=lambda r: r.vox)
    sigma = np.array([r.sigma for r in got])
    assert abs(np.median(sigma) / 12 / np.sqrt(48 / 53) - 1) < 0.03
    theta = np.array([r.theta for r in got])
    m = MODELS["balland1stick"]
    value = lambda th, s: R.rice_loglik(y, m.signal(th, P4, None, O), s[:, None]).sum(1)
    best = value(theta, sigma)
    assert np.allclose(best, [r.loglik for r in got])
    inside = ((theta[:, :2] > 0.02) & (theta[:, :2] < 0.98)).all(1)
    for k in range(6):  # no step of any parameter or of sigma improves it
        for e in (1e-3, -1e-3):
            th, s = theta.copy(), sigma.copy()
            if k < 5:
                th[:, k] *= 1 + e
            else:
                s *= 1 + e
            assert (value(th, s) <= best + 1e-5)[inside].mean() > 0.99
    plain = {r.vox: r.loglik for r in P.fit_ml(fits, ROWS, "balland1stick").collect()}
    assert all(r.loglik >= plain[r.vox] - 1e-6 for r in got)


def test_statistics_leave_pseudo_data_out(spark):
    m = MODELS["balland2sticks_orientationprior"]
    rng = np.random.default_rng(5)
    t, f = rng.uniform(0.3, 0.6, (4, 8)), np.tile([1.0, 0, 0, 0, 1.0, 0], (4, 1))
    y = m.signal(t, P4, f, O)[:, :-2] * 1.1
    rows = [(i, y[i].tolist(), t[i].tolist() if i else None, f[i].tolist(), 0.2) for i in range(4)]
    df = spark.createDataFrame(rows, "vox int, signal array<double>, theta array<double>, f array<double>, sigma double")
    got = {r.vox: r for r in P.fit_statistics(df, ROWS, m.name).collect()}
    assert got[0].rss is None and got[0].loglik is None
    for i in (1, 2, 3):
        assert np.isclose(got[i].rss, ((y[i] - y[i] / 1.1) ** 2).sum())
        assert np.isclose(got[i].loglik, R.rice_loglik(y[i], y[i] / 1.1, np.full(len(ROWS), 0.2)).sum())
    ml = {r.vox: r for r in P.fit_ml(df, ROWS, m.name).collect()}
    assert ml[0].loglik is None
    again = {r.vox: r.loglik for r in P.fit_statistics(df.drop("theta").join(P.fit_ml(df, ROWS, m.name).select("vox", "theta"), "vox"), ROWS, m.name).collect()}
    assert all(np.isclose(ml[i].loglik, again[i]) for i in (1, 2, 3))


def test_global_noise_options(spark):
    fits = spark.createDataFrame([(1, 4.0), (1, 16.0), (1, 36.0), (2, 100.0), (2, None)], "scan_id int, rss double")
    levels = spark.createDataFrame([(1, 7.0, 50.0), (2, 8.0, 60.0)], "scan_id int, noise double, signal double")
    of = lambda option, **k: {r.scan_id: r.noise for r in S.global_noise(fits, option, 5, 1, **k).collect()}
    assert of("lsqmodel") == {1: 2.0, 2: 5.0}
    assert of("logtensor", levels=levels) == {1: 7.0, 2: 8.0}
    assert of("3.5") == of(3.5) == {1: 3.5, 2: 3.5}
    for wrong in ("median", "logtensor"):
        with pytest.raises(ValueError):
            of(wrong)


def test_information_takes_short_polynomials(monkeypatch):
    """Below the last stretch the long Chebyshev series serve to make a table only."""
    a = np.linspace(0, 31.99, 50)
    want = np.stack(R.rice_information_joint(a))

    def no_series(*_):
        raise AssertionError("a long series for each value")

    monkeypatch.setattr(R.chebyshev, "chebval", no_series)
    assert np.array_equal(np.stack(R.rice_information_joint(a)), want)

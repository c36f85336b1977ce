"""Truth recovery, reductions, likelihood limits and file round trips."""

import gzip
import struct

import numpy as np
import pytest

from voxelspark.functions import columns as C
from voxelspark.operators import signals as S
from voxelspark.plans import fit as P
from voxelspark.plans.fixtures import protocol_rows
from voxelspark.plans.models import MODELS, FitOptions, Model, combine, jacobian, register
from voxelspark.plans.starts import candidates
from voxelspark.sources import scans as R

O = FitOptions()
ROWS = protocol_rows((1000.0, 2000.0))
P4 = np.array([r[1:] for r in ROWS])


def theta_for(m: Model, n=20, seed=1):
    rng = np.random.default_rng(seed)
    t = rng.uniform(0.3, 0.7, (n, m.n))
    t[:, list(m.periodic)] = rng.uniform(0.4, 1.2, (n, len(m.periodic)))
    t[:, list(m.s0)] = rng.uniform(80, 120, (n, len(m.s0)))
    return t


@pytest.mark.parametrize("name", sorted(MODELS))
def test_jacobian_against_differences(name):
    m = MODELS[name]
    t, f = theta_for(m), np.tile([0.0, 0.0, 1.0, 1.0, 0.0, 0.0], (20, 1))
    p = np.concatenate([P4] * m.times)
    j = jacobian(m, t, p, f, O)
    for k in range(m.n):
        e = np.zeros(m.n)
        e[k] = 1e-6
        d = (m.signal(t + e, p, f, O) - m.signal(t - e, p, f, O)) / 2e-6
        assert np.abs(d - j[:, :, k]).max() < 1e-4 * max(1, np.abs(d).max())


@pytest.mark.parametrize("name", [m for m in sorted(MODELS) if m not in ("exponential_decay", "complex_decay", "linear_phase", "spoiled_echo", "constant")])
def test_fits_reach_the_data(name):
    m = MODELS[name]
    t, p = theta_for(m, 30), np.concatenate([P4] * m.times)
    f = np.zeros((30, 6))
    if name == "dtv3_constrainedangles":
        f[:, :4] = np.random.default_rng(3).uniform(0.4, 1.2, (30, 4))
    elif m.n_fields:
        a = m.periodic
        for k in (0, 2):
            f[:, 3 * (k // 2) : 3 * (k // 2) + 3] = np.stack([np.sin(t[:, a[k]]) * np.cos(t[:, a[k + 1]]), np.sin(t[:, a[k]]) * np.sin(t[:, a[k + 1]]), np.cos(t[:, a[k]])], 1)
    data = m.signal(t, p, f, O)
    if m.pseudo:
        data[:, -m.pseudo :] = 0
    found = candidates(m, data, P4, S.log_linear_operator(ROWS), f, O)
    best = np.min([P.levenberg_marquardt(m, x, data, p, f, O)[1] for x in found], axis=0)
    assert np.median(np.sqrt(best / data.shape[1])) < 0.05


def test_reductions():
    t = theta_for(MODELS["dtv2"])
    full = np.insert(t, 4, t[:, 3], axis=1)
    f = np.zeros((20, 6))
    assert np.allclose(MODELS["dtv2"].signal(t, P4, f, O), MODELS["dtv1"].signal(full, P4, f, O))
    t = theta_for(MODELS["dtv3"])
    assert np.allclose(MODELS["dtv3"].signal(t, P4, f, O), MODELS["dtv2"].signal(np.insert(t, 0, 0, axis=1), P4, f, O))


def test_bessel_and_information():
    x = np.array([0.0, 0.5, 3.0, 11.9, 12.1, 50.0, 1e4])
    log_i0, ratio = P.bessel_ratio(x)
    grid = (np.arange(20000) + 0.5) * np.pi / 20000
    for a, l, r in zip(x, log_i0, ratio):
        w = np.exp(a * (np.cos(grid) - 1))
        assert abs(l - np.log(w.mean())) < 1e-10 and abs(r - (w * np.cos(grid)).mean() / w.mean()) < 1e-10
    assert abs(P.rice_information(np.array([20.0]))[0] - 1) < 0.01 and P.rice_information(np.array([0.0]))[0] < 1e-6


def test_rice_estimate_of_a_constant(spark):
    """One datum each: the likelihood's stationary point by Newton steps on the same definition."""
    data = np.linspace(2, 10, 9)
    a = data.copy()
    for _ in range(200):
        a = data * P.bessel_ratio(data * a)[1]
    df = spark.createDataFrame([([float(x)], [float(x)], 1.0, i) for i, x in enumerate(data)], "signal array<double>, theta array<double>, sigma double, i int")
    got = {r.i: r.theta[0] for r in P.fit_ml(df, [(0, 0.0, 0.0, 0.0, 0.0)], "constant").collect()}
    assert all(abs(got[i] - a[i]) < 1e-4 for i in range(9))


def test_crlb_is_the_inverse_information(spark):
    t = theta_for(MODELS["balland1stick"], 5)
    df = spark.createDataFrame([(x.tolist(), 2.0) for x in t], "theta array<double>, sigma double")
    got = [r.crlb for r in P.crlb(df, ROWS, "balland1stick", rice=False).collect()]
    j = jacobian(MODELS["balland1stick"], t, P4, np.zeros((5, 6)), O)
    want = np.linalg.inv(np.einsum("vmi,vmj->vij", j, j) / 4)[:, *np.triu_indices(5)]
    assert np.allclose(sorted(map(tuple, got)), sorted(map(tuple, want)), rtol=1e-6)


def test_edges(spark):
    bad = [[0.0] * 53, [-1.0] * 53, [float("nan")] * 53]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(bad)], "vox int, signal array<double>")
    assert all(r.theta is None for r in P.fit_lsq(df, ROWS, "balland1stick").collect())
    assert P.fit_lsq(df.limit(0), ROWS, "balland1stick").count() == 0
    with pytest.raises(ValueError):
        P.fit_lsq(df, ROWS, "balland2sticks_orientationprior")
    t = spark.createDataFrame([([1.0, 2.0, 3.0, 0.0, 0.0, 0.0],), ([-1.0, 1.0, 1.0, 0.0, 0.0, 0.0],), ([1.0, 1.0, 1.0, 0.0, 0.0, 0.0],), ([float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0],)], "d array<double>")
    got = [tuple(round(v, 6) for v in r.e) for r in t.select(C.tensor_eigenvalues(t["d"]).alias("e")).collect()]
    assert got == [(3, 2, 1, False), (1, 1, 0, True), (1, 1, 1, False), (0, 0, 0, True)]


def test_combined_and_own_models():
    register(combine("two_decays", [("exponential_decay", [[1, 0, 0], [0, 1, 0]], [0, 0]), ("exponential_decay", [[1, 0, 0], [0, 0, 1]], [0, 0])], 3))
    m = MODELS["two_decays"]
    p = np.array([[x, 0, 0, 0] for x in (0.0, 0.5, 1.0, 2.0)] * 2)
    t = np.array([[10.0, 1.0, 0.3], [5.0, 0.5, 2.0]])
    found = P.levenberg_marquardt(m, t * 1.3, m.signal(t, p, np.zeros((2, 6)), O), p, np.zeros((2, 6)), O)[0]
    assert np.allclose(found, t, rtol=1e-5)
    del MODELS["two_decays"]


def test_scan_files(spark, tmp_path):
    data = np.arange(2 * 3 * 4 * 5, dtype="<i2").reshape(5, 4, 3, 2)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 4, 2, 3, 4, 5, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 4, 16)
    struct.pack_into("<3f", head, 108, 352.0, 2.0, 1.0)
    (tmp_path / "a.nii").write_bytes(bytes(head) + data.tobytes())
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(bytes(head) + data.tobytes()))
    glob = f"{tmp_path}/*.nii*"
    h = R.read_scan_headers(spark, glob)
    assert {r.frames for r in R.scan_frames(h).collect()} == {5}
    rows = R.apply_intensity_scaling(R.read_scans(spark, glob, slices=[1, 3], volumes=[0, 4]), h).collect()
    assert len(rows) == 2 * 2 * 6 and all(r.signal == [2.0 * data[v, r.z, r.y, r.x] + 1 for v in (0, 4)] for r in rows)
    out = tmp_path / "out"
    out.mkdir()
    v = spark.createDataFrame([(7, 0, 0, 0, 1.5), (7, 1, 2, 3, -2.0)], "scan_id long, x int, y int, z int, v double")
    assert [(r.scan_id, r.voxels) for r in R.export_nifti(v, str(out), (2, 3, 4)).collect()] == [(7, 2)]
    back = {(r.x, r.y, r.z): r.signal[0] for r in R.read_scans(spark, f"{out}/*.nii.gz").collect()}
    assert back[0, 0, 0] == 1.5 and back[1, 2, 3] == -2.0 and sum(map(abs, back.values())) == 3.5 and len(back) == 24
    (tmp_path / "bval").write_text("0 1000 1000 0\n")
    (tmp_path / "bvec").write_text("0 1 0 0\n0 0 1 0\n0 0 0 0\n")
    assert [tuple(r) for r in R.read_protocol(spark, f"{tmp_path}/bval", f"{tmp_path}/bvec").orderBy("m").collect()] == [(0, 0.0, 0.0, 0.0, 0.0), (1, 1000.0, 1.0, 0.0, 0.0), (2, 1000.0, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0)]


def test_frequency_windows():
    from voxelspark.operators.grid import frequency_window

    assert frequency_window(4, 1.0, "boxcar").tolist() == [0, 1, 1, 1]
    assert frequency_window(5, 2.0, "triangular").tolist() == [0, 0.5, 1, 0.5, 0]
    np.testing.assert_allclose(frequency_window(5, 2.0, "lukosz"), [0, 0.5, 1, 0.5, 0], atol=1e-12)
    np.testing.assert_allclose(frequency_window(7, 2.0, "staircase"), [0, 0, 0, 0.5, 0, 0, 0], atol=1e-12)
    np.testing.assert_allclose(frequency_window(9, 3.0, "staircase"), [0, 0, 0, 0.5, np.sqrt(0.5), 0.5, 0, 0, 0], atol=1e-12)
    with pytest.raises(ValueError):
        frequency_window(4, 1.0, "other")


def test_reorient_refuses_oblique_axes(spark):
    from pyspark.errors import PySparkException

    from voxelspark.operators.grid import reorient_ras

    voxels = spark.createDataFrame([(1, 0, 1, 2, 5.0)], "scan_id long, x int, y int, z int, v double")
    scans = "scan_id long, affine array<double>, dims array<int>"
    turned = [0.0, -2.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    row = reorient_ras(voxels, spark.createDataFrame([(1, turned, [4, 5, 6])], scans)).first()
    assert (row.x, row.y, row.z, row.v) == (3, 0, 2, 5.0)
    for bad in ([2.0, 0.0, 0.0, 0.0, 0.9, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0], [0.0] * 12):
        with pytest.raises(PySparkException):
            reorient_ras(voxels, spark.createDataFrame([(1, bad, [4, 5, 6])], scans)).collect()


def test_apodize_counts_holes_as_zero(spark):
    from voxelspark.operators.grid import apodize

    voxels = spark.createDataFrame([(1, 0, 0, 0, 4.0), (1, 1, 1, 0, None), (1, 2, 0, 0, float("nan"))], "scan_id long, x int, y int, z int, v double")
    got = {(r.x, r.y): r.v for r in apodize(voxels, (3, 2), (9.0, 9.0), "boxcar").collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {(0, 0): 4.0, (1, 1): 0.0, (2, 0): 0.0}
    assert apodize(voxels.limit(0), (3, 2), (9.0, 9.0)).count() == 0


def test_rows_without_theta_stay(spark):
    rows = [(1, [1.0, 0.5], None, 0.1), (2, [1.0, 0.5], None, None)]
    fitted = spark.createDataFrame(rows, "vox int, signal array<double>, theta array<double>, sigma double")
    protocol = [(0, 1.0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0, 1000.0)]
    ml = P.fit_ml(fitted, protocol, "balland1stick").collect()
    assert sorted((r.vox, r.theta, r.loglik) for r in ml) == [(1, None, None), (2, None, None)]
    assert sorted((r.vox, r.crlb) for r in P.crlb(fitted, protocol, "balland1stick").collect()) == [(1, None), (2, None)]

"""Fits are dealt over tasks, and derivatives in closed form are those of complex steps."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import signals as S
from voxelspark.plans import fit as P
from voxelspark.plans.fixtures import protocol_rows
from voxelspark.plans.models import MODELS, FitOptions, jacobian, signal_and_slopes

TWO = protocol_rows((1000.0, 2000.0))


@pytest.mark.parametrize("name", sorted(n for n, m in MODELS.items() if m.slopes))
def test_slopes(name):
    m, o, rng = MODELS[name], FitOptions(), np.random.default_rng(3)
    full = np.concatenate([np.array([r[1:5] for r in TWO], float)] * m.times)
    t, f = rng.uniform(0.1, 0.9, (9, m.n)), rng.normal(size=(9, 2, 3))
    f = (f / np.linalg.norm(f, axis=2, keepdims=True)).reshape(9, 6)
    value, slopes = signal_and_slopes(m, t, full, f, o)
    steps = jacobian(replace(m, slopes=None), t, full, f, o).transpose(0, 2, 1)
    assert np.abs(value - m.signal(t, full, f, o)).max() < 1e-14
    assert (np.abs(slopes - steps).max((0, 2)) < 1e-12 * np.abs(steps).max((0, 2))).all()


def test_prior_slopes_at_its_direction():
    m, o = MODELS["balland2sticks_orientationprior"], FitOptions()
    full = np.array([r[1:5] for r in TWO], float)
    t, f = np.array([[0.2, 0.6, 0.5, 0.0, 0.0, 1.0, 0.5, 1.0]]), np.array([[0.0, 0.0, 1.0, 1.0, 0.0, 0.0]])
    assert np.abs(jacobian(m, t, full, f, o) - jacobian(replace(m, slopes=None), t, full, f, o)).max() < 1e-12


def test_built_in_models_have_slopes():
    """Else each derivative costs a complex evaluation of the model."""
    assert {n for n, m in MODELS.items() if "stick" in n or "tensor" in n or n.startswith(("st", "dtv"))} <= {n for n, m in MODELS.items() if m.slopes}


def test_groups_of_voxels_do_not_matter(monkeypatch):
    m, o, rng = MODELS["balland1stick"], FitOptions(), np.random.default_rng(4)
    full = np.array([r[1:5] for r in TWO], float)
    truth = rng.uniform(0.2, 0.8, (300, m.n))
    data = m.signal(truth, full, np.zeros((300, 6)), o) * (1 + 0.01 * rng.normal(size=(300, len(full))))
    one = P.levenberg_marquardt(m, truth * 1.05, data, full, np.zeros((300, 6)), o)
    monkeypatch.setattr(P, "TOGETHER", 7)
    many = P.levenberg_marquardt(m, truth * 1.05, data, full, np.zeros((300, 6)), o)
    assert all(np.allclose(a, b, rtol=1e-6) for a, b in zip(one, many))
    assert [len(x) for x in P.levenberg_marquardt(m, truth[:0], data[:0], full, np.zeros((0, 6)), o)] == [0, 0, 0]


def test_fits_are_dealt_over_tasks(spark, tmp_path):
    """One small file is one task by its bytes."""
    theta = F.array(F.lit(0.4), F.lit(0.5), F.lit(0.7), 0.1 + F.col("vox") / 1000, F.lit(100.0))
    spark.range(400).select((F.col("id") % 2).alias("scan_id"), F.col("id").alias("vox"), theta.alias("theta")).coalesce(1).write.parquet(f"{tmp_path}/t")
    voxels = spark.read.parquet(f"{tmp_path}/t")
    assert voxels.rdd.getNumPartitions() == 1
    dwi = P.simulate(voxels, TWO, "balland1stick").drop("theta")
    fits = P.fit_lsq(dwi, TWO, "balland1stick")
    tasks = [df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect() for df in (dwi, fits)]
    assert all(len(t) >= 16 and max(r["count"] for r in t) <= 100 for t in tasks)
    assert S.spread(voxels).orderBy("vox").collect() == voxels.orderBy("vox").collect()


def test_bessel_pieces(monkeypatch):
    """Each series runs on its own values only: pieces, edges and both sides of 12 agree with one value at a time."""
    from voxelspark.plans import rice

    x = np.array([[0.0, 1e-9, 0.5, 11.999999], [12.0, 12.000001, 700.0, 1e6]])
    whole = rice.bessel_ratio(x)
    each = [rice.bessel_ratio(np.array(v)) for v in x.ravel()]
    monkeypatch.setattr(rice, "_PIECE", 3)
    for k, pieces in enumerate(rice.bessel_ratio(x)):
        assert (pieces == whole[k]).all() and (pieces.ravel() == [e[k] for e in each]).all()
    assert abs(whole[1][0, 2] - 0.24249961258) < 1e-10 and [len(a) for a in rice.bessel_ratio(np.zeros(0))] == [0, 0]


def test_weighted_square():
    from voxelspark.plans.models import weighted_square

    rng = np.random.default_rng(6)
    j, w = rng.normal(size=(4, 9, 3)), rng.uniform(size=(4, 9))
    assert np.allclose(weighted_square(j, w), np.einsum("vmi,vm,vmj->vij", j, w, j), rtol=1e-13)


@pytest.mark.parametrize("name", ["dtv3", "dtv3_constrainedangles", "balland2sticks_orientationprior"])
def test_model_queries_stay_with_their_rows(spark, tmp_path, name):
    """One shuffle and no join, so nothing goes through the driver; rows of one key are rows of their own, one without a key stays."""
    from voxelspark.queries import QUERIES

    keys = [*range(40), 7, 7, None]
    rows = [(k, 900.0 + i, i % 50 + 1) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "p_partkey bigint, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES[f"m9_model_{name}"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange") == 1
    found = got.collect()
    assert sorted(-1 if r["vox"] is None else r["vox"] for r in found) == sorted(-1 if k is None else k for k in keys)
    assert len({tuple(r) for r in found if r["vox"] == 7}) == 1


def test_dealt_rows_are_not_shuffled_again(spark):
    theta = F.array(F.lit(0.4), F.lit(0.5), F.lit(0.7), 0.1 + F.col("id") / 1000, F.lit(100.0))
    dwi = P.simulate(spark.range(60).select(F.col("id").alias("vox"), theta.alias("theta")), TWO, "balland1stick").drop("theta")
    once, twice = (P.fit_lsq(dwi, TWO, "balland1stick", dealt=d) for d in (True, False))
    assert [df._jdf.queryExecution().executedPlan().toString().count("Exchange") for df in (once, twice)] == [1, 2]
    both = [{r["vox"]: r["theta"] for r in df.collect()} for df in (once, twice)]
    assert both[0].keys() == both[1].keys() == set(range(60)) and all(np.allclose(both[0][v], both[1][v], rtol=1e-6) for v in both[0])

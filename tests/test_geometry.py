"""Geometry from headers and the acquisition grid."""

import numpy as np
import pytest

from voxelspark.operators.geometry import acquisition_affine, acquisition_grid, acquisition_size, scan_affine
from voxelspark.operators.grid import fft_resample

HEADER = "scan_id long, spacings array<array<double>>, orientation array<double>, positions array<array<double>>, locations array<double>, between double, mosaic boolean, normal array<double>"
AXIAL = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def test_affine_of_header_kinds(spark):
    here = [[1.0, 2.0, 3.0]]
    rows = [
        (0, None, AXIAL, here, None, None, None, None),  # nothing stated: pixels of 1, no slice distance
        (1, [[2.0, 3.0]] * 4, [*AXIAL, 0.0, 0.6, 0.8], here, [5.0, 7.0], None, None, None),  # a third vector
        (2, [], AXIAL, [[1.0, 2.0, 3.0], [1.0, 2.0, 5.0], [1.0, 2.0, 7.0], [1.0, 2.0, 90.0]], None, 2.0, False, None),  # the median step, one outlier
        (3, [[1.0, 1.0]], AXIAL, here * 2, None, 2.5, True, [0.0, 0.6, -0.8]),  # positions that don't move: the normal
        (4, [[1.0, 1.0]], AXIAL, [[1.0, 2.0, 3.0], [1.0, 2.0, 2.0]], [0.0, 9.0], None, None, None),  # positions before locations
    ]
    got = {r.scan_id: np.array(r.affine).reshape(3, 4) for r in scan_affine(spark.createDataFrame(rows, HEADER)).collect()}
    third = {0: [0, 0, 0], 1: [0, 1.2, 1.6], 2: [0, 0, 2], 3: [0, 1.5, -2], 4: [0, 0, -1]}
    for i, a in got.items():
        assert np.allclose(a[:, 3], here[0]) and np.allclose(a[:, 2], third[i])
        assert np.allclose(a[:, 0], [0, 3 if i == 1 else 1, 0]) and np.allclose(a[:, 1], [2 if i == 1 else 1, 0, 0])
    assert len(got) == 5
    uneven = spark.createDataFrame([(0, [[1.0, 1.0], [1.2, 1.0]], AXIAL, here, None, None, None, None)], HEADER)
    with pytest.raises(Exception, match="pixel spacing differs"):
        scan_affine(uneven).collect()


def test_acquisition_sizes(spark):
    schema = "scan_id long, dims array<int>, matrix array<int>, volumetric boolean, thickness double, between double, affine array<double>"
    affine = [1.0, 0.0, 0.0, 5.0, 0.0, 1.0, 0.0, 6.0, 0.0, 0.0, 1.0, 7.0]
    rows = [
        (0, [128, 128, 20], [0, 64, 48, 0], False, 4.0, 2.0, affine),
        (1, [128, 128, 20], [48, 0, 0, 64], True, 4.0, 2.0, affine),
        (2, [128, 128, 21], None, None, 2.0, 2.0, affine),
        (3, [60, 60, 21], [0, 64, 64, 0], None, 4.0, 2.0, affine),
    ]
    got = {r.scan_id: r for r in acquisition_affine(acquisition_size(spark.createDataFrame(rows, schema))).collect()}
    assert [got[i]["size"] for i in range(4)] == [[70, 53, 10], [70, 53, 12], [128, 128, 21], [60, 60, 11]]
    assert np.allclose(got[0].affine, [128 / 70, 0, 0, 5, 0, 128 / 53, 0, 6, 0, 0, 2, 7])
    both = spark.createDataFrame([(0, [8, 8, 8], [1, 2, 0, 0], False, 1.0, 1.0, affine)], schema)
    with pytest.raises(Exception, match="both pairs"):
        acquisition_size(both).collect()


def test_grid_of_scans_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    sizes = {1: ((6, 5, 4), (4, 5, 3)), 2: ((4, 4, 4), (3, 2, 4)), 3: ((6, 5, 4), (6, 5, 4))}
    rows = [(s, x, y, z, float(rng.normal())) for s, (n, _) in sizes.items() for x, y, z in np.ndindex(*n)]
    rows = [(s, x, y, z, None if (x, y, z) == (1, 1, 1) else v) for s, x, y, z, v in rows] + [(9, 0, 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "scan_id long, x int, y int, z int, v double").repartition(5)
    scans = spark.createDataFrame([(s, list(n), list(m)) for s, (n, m) in sizes.items()], "scan_id long, dims array<int>, size array<int>")
    got = {tuple(r)[:4]: r.v for r in acquisition_grid(df, scans).collect()}
    want = {}
    for s, (n, m) in sizes.items():
        want |= {tuple(r)[:4]: r.v for r in fft_resample(df.where(f"scan_id = {s}"), n, m).collect()}
    want = {k: v or 0.0 for k, v in want.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert acquisition_grid(df.limit(0), scans).count() == 0

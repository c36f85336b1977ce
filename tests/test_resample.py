import numpy as np
import pytest

from voxelspark.operators import grid as G


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8])
@pytest.mark.parametrize("m", [1, 2, 3, 4, 7, 8, 12])
def test_band_limited_lines_are_met_exactly(n, m):
    """Constants and waves below both limits keep their values; sampling up and down again gives the line back."""
    a = G.spectral_matrix(n, m)
    assert np.allclose(a @ np.ones(n), 1)
    for k in range(1, (min(n, m) - 1) // 2 + 1):
        wave = lambda x, k=k: np.cos(2 * np.pi * k * x + 0.3)
        assert np.allclose(a @ wave(np.arange(n) / n), wave(np.arange(m) / m))
    if m >= n:
        assert np.allclose(G.spectral_matrix(m, n) @ a, np.eye(n))


def test_shift_and_compensation():
    wave = lambda x: np.cos(2 * np.pi * x + 0.4)
    assert np.allclose(G.spectral_matrix(8, 8, 0.7) @ wave(np.arange(8) / 8), wave((np.arange(8) - 0.7) / 8))
    assert np.allclose(G.spectral_matrix(5, 5, 2.0), np.roll(np.eye(5), 2, axis=0))
    flat, sharp = (G.spectral_matrix(8, 16, 0, c) @ wave(np.arange(8) / 8) for c in (False, True))
    assert np.allclose(sharp, flat / np.sinc(1 / 16) ** 2)


def test_lines_with_gaps_and_more_columns(spark):
    rows = [(1, x, y, 0, 5, float(x + 10 * y)) for x in range(4) for y in range(3)]
    df = spark.createDataFrame([r for r in rows if r[1:3] != (2, 1)] + [(1, 2, 1, 0, 5, float("nan"))], "scan_id int, x int, y int, z int, m int, v double")
    got = {(r.x, r.y): r.v for r in G.fft_resample(df, (4, 3, 1), (6, 5, 1), by=("m",)).collect()}
    data = np.array([[0.0 if (x, y) == (2, 1) else x + 10 * y for y in range(3)] for x in range(4)])
    want = G.spectral_matrix(4, 6) @ data @ G.spectral_matrix(3, 5).T
    assert len(got) == 30 and all(np.isclose(got[i, j], want[i, j]) for i in range(6) for j in range(5))
    same = G.fft_resample(df, (4, 3, 1), (4, 3, 1), by=("m",))
    assert same.columns == ["scan_id", "x", "y", "z", "m", "v"] and same.count() == df.count()
    assert G.fft_resample(df.limit(0), (4, 3, 1), (6, 5, 1)).count() == 0

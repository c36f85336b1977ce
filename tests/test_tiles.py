"""Operators that work on tiles, against plain loops."""

import itertools
import math

import numpy as np
import pytest

from voxelspark.operators import grid as G


def brute_minima(rows):
    at = {}
    for s, x, y, z, v in rows:
        at.setdefault((s, x, y, z), []).append(v)
    below = lambda u, w: u is not None and w is not None and (u < w or (math.isnan(w) and not math.isnan(u)))
    same = lambda u, w: u is not None and w is not None and (u == w or (math.isnan(w) and math.isnan(u)))
    out = []
    for s, x, y, z, v in rows:
        near = [(d, u) for d in itertools.product((-1, 0, 1), repeat=3) if any(d) for u in at.get((s, x + d[2], y + d[1], z + d[0]), [])]
        if not any(below(u, v) or (d > (0, 0, 0) and same(u, v)) for d, u in near):
            out.append((s, x, y, z, v))
    return out


@pytest.mark.parametrize("tile", [1, 2, 3, 16])
def test_full_minima(spark, tile):
    """Holes, ties, nulls, NaN, two rows at a place, negative places, many small scans and one that spans tiles."""
    rng = np.random.default_rng(tile)
    rows = [(s, *map(int, p - 2), float(rng.integers(0, 5))) for s in range(6) for p in rng.permutation(list(itertools.product(range(7 if s == 5 else 3), repeat=3)))[: 200 if s == 5 else 20]]
    rows += [(7, 0, 0, 0, None), (7, 0, 0, 1, 2.0), (7, 0, 1, 1, 3.0), (7, 3, 3, 3, math.nan), (7, 3, 3, 4, math.nan), (7, 3, 4, 4, 9.0), (8, 0, 0, 0, 1.0), (8, 0, 0, 0, 3.0), (8, 1, 0, 0, 2.0)]
    df = spark.createDataFrame(rows, "scan_id long, x int, y int, z int, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # groups that go on over batches
    try:
        out = [tuple(r) for r in G.full_minima(df, tile=tile).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, out)) == sorted(map(repr, brute_minima(rows)))


def test_full_minima_makes_no_pairs(spark):
    """A row for each neighbour was 26 times the volume, on one side of a join whose size Spark takes from the small file."""
    df = spark.range(64).selectExpr("0L AS scan_id", "cast(id % 4 AS int) AS x", "cast(id / 4 % 4 AS int) AS y", "cast(id / 16 AS int) AS z", "1D AS v")
    assert "Join" not in G.full_minima(df)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("method", ["trilinear", "nearest"])
def test_reslice_tiles_do_not_matter(spark, method):
    """Tiles of 2 and 16, small batches, holes, a scan without voxels, voxels outside the dims and voxels without a scan."""
    from voxelspark.operators import reslice as R

    rng = np.random.default_rng(5)
    spots = [p for p in itertools.product(range(5), range(4), range(6)) if rng.random() < 0.9]
    rows = [(s, *p, float(rng.normal())) for s in (1, 2, 9) for p in spots] + [(1, 7, 0, 0, 100.0)]
    df = spark.createDataFrame(rows, "scan_id long, x int, y int, z int, v double")
    turned = [1.8, -1.0, 0.1, -3.2, 1.1, 2.0, 0.0, 4.7, 0.0, 0.3, 2.5, 1.1]
    scans = spark.createDataFrame([(1, turned, [5, 4, 6]), (2, turned, [5, 4, 6]), (3, turned, [5, 4, 6])], "scan_id long, affine array<double>, dims array<int>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 41)
    try:
        one, two = (sorted(map(tuple, R.reslice(df, scans, (1.1, 1.3, 1.7), method, tile=t).collect())) for t in (2, 16))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    size = R.target_grid(scans, (1.1, 1.3, 1.7)).selectExpr("sum(new_dims[0] * new_dims[1] * new_dims[2])").first()[0]
    assert len(one) == len({r[:4] for r in one}) == size and [r[:4] for r in one] == [r[:4] for r in two]
    assert np.allclose([r[4] for r in one], [r[4] for r in two], atol=1e-12)
    assert all(r[4] == 0 for r in one if r[0] == 3) and any(r[4] != 0 for r in one if r[0] == 2)


def test_reslice_sends_no_targets(spark):
    """A row for each target was shuffled and sorted in a task; now only voxels and a header for each tile are."""
    from voxelspark.operators import reslice as R

    df = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 1, 1, 1, 3.0)], "scan_id long, x int, y int, z int, v double")
    scans = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0], [2, 2, 2])], "scan_id long, affine array<double>, dims array<int>")
    plan = R.reslice(df, scans, (0.1, 0.1, 0.1), background=0.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Group" not in plan and plan.count("Repartition") == 1

import os

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from voxelspark.llm import cover_tree as C

SF = "/root/testdata/sf0.01"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100):
    fit = []
    for vec_id, label, v in rows:
        if None in (vec_id, label, v) or any(c is None or not np.isfinite(c) for c in v):
            continue
        fit.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(np.floor(256 * np.array(v, float)))))
    fit, out = list(dict.fromkeys(fit)), []
    for a in fit:
        if a[0] % every:
            continue
        score = lambda r: int(np.dot(a[2], r[2]))
        others = [(-score(r), r[0], r[1]) for r in fit if r is not a and len(r[2]) == len(a[2])]
        for s, i, _ in sorted(x for x in others if x[2] == a[1])[:5]:
            inside = sorted(x for x in others if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(inside)]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, Query string, key int").repartition(3)
    return sorted(tuple(r) for r in C.hard_negatives(df, **options).select(*NAMES).collect())


def vectors(n, dim, labels=10, seed=1, centres=12):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(centres, dim))
    x = mid[rng.integers(0, centres, n)] + 0.2 * rng.normal(size=(n, dim))
    return [(int(i), int(rng.integers(0, labels)), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def test_bounds_hold_for_every_point_below_a_node():
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=(500, 6)) * 100, np.repeat(rng.normal(size=(4, 3)) * 50, 60, axis=0), np.zeros((40, 2)), rng.normal(size=(1, 4))):
        x = np.floor(x)
        order, nodes = C.build(x, leaf=8)
        assert sorted(order) == list(range(len(x)))
        big, top = C.augment(x)
        q = np.floor(rng.normal(size=(9, x.shape[1])) * 100)
        centres = x[nodes[:, 0].astype(int)]
        low, high = C.bounds(q @ centres.T, nodes[:, 5], np.sqrt((q * q).sum(1)), top)
        for k, (c, parent, level, a, b, r) in enumerate(nodes):
            below = order[int(a) : int(b)]
            assert np.sqrt(((big[below] - big[int(c)]) ** 2).sum(1)).max() <= r + 1e-9
            s = q @ x[below].T
            assert (s >= low[:, [k]]).all() and (s <= high[:, [k]]).all()
            if parent >= 0:
                up = nodes[int(parent)]
                assert up[3] <= a and b <= up[4] and up[2] == level - 1


def test_clustered_points_are_skipped():
    rows = vectors(4000, 5, seed=4)
    x = np.floor(256 * np.array([r[2] for r in rows]))
    order, nodes = C.build(x)
    tree = {"x": x[order], "ids": order, "labels": np.arange(len(x)) % 2, "keys": order, "nodes": nodes, "centres": x[nodes[:, 0].astype(int)]}
    q = {"x": x[:50], "label": np.zeros(50, int), "key": np.arange(50), "lo": np.full(50, -np.inf), "hi": np.full(50, np.inf), "same": False}
    best = C.Best(50, 10)
    scored = C.search(tree, q, best)
    assert scored < 50 * len(x) / 3 and len(best.query) == 500
    for k in range(50):
        mine = [(-float(x[k] @ x[o]), int(o)) for o, label in zip(order, tree["labels"]) if label and o != k]
        assert [(-s, i) for s, i in zip(best.score[best.query == k], best.id[best.query == k])] == sorted(mine)[:10]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "GROUP", 1)
    monkeypatch.setattr(C, "BLOCK", 7)
    monkeypatch.setattr(C.grow, "__defaults__", (64,))
    rows = vectors(900, 8)
    assert got(spark, rows, every=20) == brute(rows, 20)


def test_ties_hot_label_nulls_and_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), 3 if i % 3 else int(i % 11), [float(c) for c in rng.integers(-2, 3, 3) / 256]) for i in range(400)]
    rows += rows[:30]  # repeated rows
    rows += [(None, 1, [1.0, 0.0, 0.0]), (500, None, [1.0, 0.0, 0.0]), (600, 1, None), (700, 1, [None, 0.0, 1.0]), (800, 1, [float("nan"), 0.0, 1.0]), (900, 1, [float("inf"), 0.0, 1.0])]
    rows += [(1000, 1, [0.5, 0.5]), (1001, 1, [0.5, 0.25]), (1003, 2, [0.25, 0.25]), (1100, 1, [0.0, 0.0]), (1200, 5, []), (100, 4, [0.25, 0.5, 0.5])]
    assert got(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, 1, [1.0, 1.0])]) == []
    rows = [(0, 1, [1.0, 1.0]), (100, 2, [0.5, 0.5]), (7, 0, [0.75, 1.0]), (3, 1, [1.0, 1.0])]
    assert got(spark, rows) == brute(rows) != []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_and_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(duck.sql(f"SELECT {', '.join(NAMES)} FROM ({C.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in C.op12_hard_negatives(spark, SF).select(*NAMES).collect()) == want and len(want) > 100
    assert C.op12_hard_negatives(spark, SF).where(F.col("negative_score") > F.col("positive_score")).count() == 0

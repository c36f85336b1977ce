import random

import pytest

from voxelspark.functions.text import EditCosts, edit_distances, weighted_edit_distance
from voxelspark.operators.channels import merge_channels, split_channels


def table(a, b, c):
    d = [[j * c.insertion for j in range(len(b) + 1)]]
    for i, x in enumerate(a):
        row = [d[-1][0] + c.deletion]
        for j, y in enumerate(b):
            cost = 0.0 if x == y else c.replacement
            if c.case is not None and x != y and x.isascii() and x.isalpha() and x.swapcase() == y:
                cost = c.case
            for p, q, v in c.pairs:
                cost = v if (x, y) == (p, q) else cost
            row.append(min(d[-1][j] + cost, d[-1][j + 1] + c.deletion, row[j] + c.insertion))
        d.append(row)
    return d[-1][-1]


@pytest.mark.parametrize("costs", [EditCosts(2, 3, 4), EditCosts(1, 1, 1.5, case=0.25), EditCosts(0.7, 1.1, 1, pairs=(("a", "b", 0.1), ("é", "e", 0.0))), EditCosts(1, 1, 9)])
def test_weighted_distance(costs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abABeé🙂[{") for _ in range(rng.choice([0, 1, 3, 9])))
    left, right = [word() for _ in range(700)], [word() for _ in range(700)]
    assert [round(x, 9) for x in edit_distances(left, right, costs)] == [round(table(a, b, costs), 9) for a, b in zip(left, right)]


def test_distance_column(spark):
    df = spark.createDataFrame([("Abc", "abd"), (None, "a"), ("", "xy"), ("a", None)], "a string, b string")
    assert [r.d for r in df.select(weighted_edit_distance(df.a, df.b, EditCosts(2, 2, 2, case=0.5)).alias("d")).collect()] == [2.5, None, 4.0, None]
    assert [r.d for r in df.select(weighted_edit_distance(df.a, df.b).alias("d")).collect()] == [2.0, None, 2.0, None]


def test_channels(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [4.0])], "vox int, v array<double>")
    parts = split_channels(df, "v", ["x", "y", "z"])
    assert sorted(map(tuple, parts.collect())) == [(1, 1.0, 2.0, 3.0), (2, None, None, None), (3, 4.0, None, None)]
    back = merge_channels(parts, ["x", "y", "z"], "v")
    assert {r.vox: r.v for r in back.collect()} == {1: [1.0, 2.0, 3.0], 2: None, 3: None}
    two = merge_channels(df.withColumn("w", df.v), ["v", "w"], "d")
    assert {r.vox: r.d for r in two.collect()} == {1: [1.0, 2.0, 3.0] * 2, 2: None, 3: [4.0, 4.0]}
    with pytest.raises(ValueError):
        split_channels(df, "v", ["Vox"])

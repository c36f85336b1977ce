"""Block sweeps over a grid: blocks of one colour are solved in parallel, each with the voxels around it held fixed.

A block belongs to one of eight colours by the parity of its coordinates, so
blocks of a colour do not touch as long as the halo is no wider than a block.
After a colour its voxels are written to shared storage and the next colour
reads them; a sweep writes every voxel once.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.operators.grid import map_groups
from voxelspark.sources.store import remove, stored

AXES = ("x", "y", "z")
Size = tuple[int, int, int]
Solve = Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]


def _colour(at: list[Column]) -> Column:
    return sum((F.pmod(b, F.lit(2)) * 2**i for i, b in enumerate(at)), F.lit(0)).cast("int")


def _around(state: DataFrame, colour: int, size: Size, halo: int) -> DataFrame:
    """Rows of each voxel in every block of the colour that holds it or has it within its halo."""
    for i, (a, n) in enumerate(zip(AXES, size)):
        blocks = F.sequence(F.floor((F.col(a) - halo) / n), F.floor((F.col(a) + halo) / n))
        parity = F.lit((colour >> i) % 2)
        own = F.filter(blocks, lambda b: F.pmod(b, F.lit(2)) == parity)  # noqa: B023
        state = state.withColumn(f"_b{a}", F.explode(own))
    return state


def block_sweep(df: DataFrame, solve: Solve, size: Size, halo: int, by: tuple[str, ...] = ("scan_id",)) -> Iterator[DataFrame]:
    """Sweeps without end: after each one, all rows as they are then.

    df has the columns of `by`, x, y, z and the state. solve(rows, own) gets a
    block with its halo (own marks the block's rows) and returns the block's
    rows with their new state; where its linear algebra fails the rows stay as
    they are. A group is a block: at most the product of size + 2 halo voxels.
    The state that an earlier sweep returned must not be read any more once
    the next sweep has begun: its files are removed.
    """
    if halo > min(size):
        raise ValueError("a halo wider than a block would reach blocks of the same colour")
    if clash := [c for c in df.columns if c in {f"_b{a}" for a in AXES} | {f"_k{i}" for i in range(len(by))}]:
        raise ValueError(f"columns of the sweep: {clash}")
    spark, columns, lengths = df.sparkSession, df.columns, np.array(size)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    home = _colour([F.floor(F.col(a) / n) for a, n in zip(AXES, size)])

    def solved(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        own = (np.floor_divide(rows[list(AXES)].to_numpy(), lengths) == rows[[f"_b{a}" for a in AXES]].to_numpy()).all(1)
        first, plain, out = np.flatnonzero(np.diff(group, prepend=-1)), rows[columns], []
        for lo, hi in zip(first, [*first[1:], len(rows)]):
            mine = own[lo:hi]
            if not mine.any():
                continue
            block = plain.iloc[lo:hi].reset_index(drop=True)
            try:
                out.append(solve(block, mine)[columns])
            except np.linalg.LinAlgError:
                out.append(block.loc[mine])
        return pd.concat(out) if out else plain.iloc[:0]

    # names of groups that are never null
    names = {f"_k{i}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for i, c in enumerate(by)}
    keys = [*names, *[f"_b{a}" for a in AXES]]
    first, path = stored(df.withColumn("_colour", home))
    colours = sorted(r[0] for r in first.select("_colour").distinct().collect())
    parts = {c: (first.where(F.col("_colour") == c).drop("_colour"), None) for c in colours}
    gone = [path]
    while True:
        for c in colours:
            state = functools.reduce(DataFrame.unionByName, [p for p, _ in parts.values()])
            new = stored(map_groups(_around(state, c, size, halo).withColumns(names), keys, solved, schema))
            gone += [parts[c][1]] if parts[c][1] else []
            parts[c] = new
        yield functools.reduce(DataFrame.unionByName, [p for p, _ in parts.values()]) if parts else df
        for p in gone:
            remove(spark, p)
        gone = []


def laplacian(at: np.ndarray) -> np.ndarray:
    """Matrix of the sum over axes of both neighbours' differences to each voxel; a neighbour that is not there counts as the voxel itself."""
    at = at - at.min(0, initial=0) + 1
    number = np.full(at.max(0, initial=0) + 2, -1)
    number[tuple(at.T)] = np.arange(len(at))
    out = np.zeros((len(at), len(at)))
    for a, step in itertools.product(range(3), (-1, 1)):
        j = number[tuple((at + step * np.eye(3, dtype=int)[a]).T)]
        i = np.flatnonzero(j >= 0)
        out[i, j[i]] += 1
        out[i, i] -= 1
    return out


@functools.lru_cache(maxsize=16)
def _block_solution(at: bytes, own: bytes, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The own voxels of a block as a linear map of their values and of the halo; blocks of a regular grid have few shapes, so a task works most of them out once."""
    mine = np.frombuffer(own, bool)
    m = -weight * laplacian(np.frombuffer(at, np.int64).reshape(-1, 3))
    inner = np.linalg.inv(m[np.ix_(mine, mine)] + np.eye(mine.sum()))
    return inner, -inner @ m[np.ix_(mine, ~mine)]


def smooth_field(df: DataFrame, weight: float, size: Size = (8, 8, 8), value: str = "v", tolerance: float = 1e-9, sweeps: int = 50, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """The field u with the smallest sum of (u - v)^2 + weight * (differences of neighbours)^2, by block sweeps until no value moves by more than tolerance.

    Voxels that are not there have no part in it. Returns by, x, y, z and the value.
    """
    rows = df.select(*by, *AXES, F.col(value).cast("double").alias("_v"), F.col(value).cast("double").alias("_u"), F.lit(0.0).alias("_moved"))

    def solve(block: pd.DataFrame, own: np.ndarray) -> pd.DataFrame:
        at = block[list(AXES)].to_numpy().astype(np.int64)
        order = np.lexsort(at.T)
        at, own = at[order] - at.min(0), own[order]
        inner, outer = _block_solution(at.tobytes(), own.tobytes(), weight)
        block = block.iloc[order]
        u, v = block["_u"].to_numpy(), block["_v"].to_numpy()
        new = inner @ v[own] + outer @ u[~own]
        return block[own].assign(_u=new, _moved=np.abs(new - u[own]))

    for k, state in enumerate(block_sweep(rows, solve, size, 1, by)):
        moved = state.agg(F.max("_moved")).first()[0]
        if moved is None or moved <= tolerance:
            break
        if k + 1 == sweeps:
            raise RuntimeError(f"values still move by {moved} after {sweeps} sweeps")
    return state.select(*by, *AXES, F.col("_u").alias(value))

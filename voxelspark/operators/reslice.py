"""Reslicing to an axis-aligned grid: target voxels are made in tiles of the source, each tile with one more layer of voxels."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.operators.grid import map_groups

AXES = ("x", "y", "z")
EDGE = 0.05  # so far outside the outermost voxel centres, in voxels, a value is still taken from the edge


def _entry(i: int, j: int) -> Column:
    return F.col("affine")[4 * i + j]


def _inverse() -> list[list[Column]]:
    """Inverse of the 3 x 3 part of affine, by cofactors."""
    minor = lambda i, j: _entry((i + 1) % 3, (j + 1) % 3) * _entry((i + 2) % 3, (j + 2) % 3) - _entry((i + 1) % 3, (j + 2) % 3) * _entry((i + 2) % 3, (j + 1) % 3)
    size = sum((_entry(0, j) * minor(0, j) for j in range(1, 3)), _entry(0, 0) * minor(0, 0))
    return [[minor(j, i) / size for j in range(3)] for i in range(3)]


def target_grid(scans: DataFrame, voxel_size: tuple[float, float, float]) -> DataFrame:
    """Per scan: origin (the rounded smallest corner, in mm) and new_dims of the axis-aligned grid that holds all of its corners.

    scans has scan_id, affine (rows x, y, z of four doubles, one array of 12)
    and dims (array of 3).
    """
    corners = []
    for i in range(3):
        at = [sum((_entry(i, j) * (F.col("dims")[j] - 1 if far else F.lit(0)) for j, far in enumerate(c)), _entry(i, 3)) for c in itertools.product((0, 1), repeat=3)]
        corners.append((F.round(F.least(*at)), F.round(F.greatest(*at))))
    dims = [F.ceil((hi - lo) / s + 1).cast("int") for (lo, hi), s in zip(corners, voxel_size)]
    return scans.select("scan_id", "affine", "dims", F.array(*[lo for lo, _ in corners]).alias("origin"), F.array(*dims).alias("new_dims"))


def _tile_values(rows: pd.DataFrame, group: np.ndarray, voxel_size: tuple[float, float, float], method: str, tile: int) -> pd.DataFrame:
    """Targets of each tile: those of the box around it in the target grid whose place is inside the source and whose lower corner is in the tile."""
    headed = np.flatnonzero(rows["dims"].notna().to_numpy())
    tiles, first = np.unique(group[headed], return_index=True)
    number = np.full(group.max(initial=-1) + 1, -1)
    number[tiles] = np.arange(len(tiles))
    head, group = rows.iloc[headed[first]], number[group]
    cubes = np.zeros((len(tiles), *(tile + 1,) * 3))
    corner = head[["tx", "ty", "tz"]].to_numpy(np.int64) * tile
    mine = np.flatnonzero(rows["sx"].notna().to_numpy() & (group >= 0))  # a tile without a header is not in its scan
    at = rows[["sx", "sy", "sz"]].to_numpy(float)[mine].astype(np.int64) - corner[group[mine]]
    fit = ((at >= 0) & (at <= tile)).all(1)
    cubes[(group[mine[fit]], *at[fit].T)] = np.nan_to_num(rows["_v"].to_numpy(float)[mine[fit]], nan=0.0, posinf=0.0, neginf=0.0)
    if not len(tiles):
        return pd.DataFrame({"scan_id": head["scan_id"], **{c: [] for c in (*AXES, "_v")}})
    inverse, shift, origin = (np.stack(head[c].to_numpy()).astype(float) for c in ("inverse", "shift", "origin"))
    inverse = inverse.reshape(-1, 3, 3)
    dims, new = (np.stack(head[c].to_numpy()).astype(np.int64) for c in ("dims", "new_dims"))
    steps = np.array(voxel_size)
    # the box: the tile with a voxel around it, turned back to the target grid
    forward = np.linalg.inv(inverse)
    ends = np.stack([corner - 1.5, np.minimum(corner + tile, dims) + 0.5], 1)
    corners = np.stack([ends[:, c, range(3)] for c in itertools.product((0, 1), repeat=3)], 1)
    box = (np.einsum("gij,gcj->gci", forward, corners) + (shift - origin)[:, None]) / steps
    lo, hi = np.maximum(np.floor(box.min(1)).astype(np.int64), 0), np.minimum(np.ceil(box.max(1)).astype(np.int64), new - 1)
    count = np.maximum(hi - lo + 1, 0)
    total, out = count.prod(1), []
    whole = np.concatenate([[0], np.cumsum(total)])
    for begin in range(0, whole[-1], 1 << 18):
        i = np.arange(begin, min(begin + (1 << 18), whole[-1]))
        g = np.searchsorted(whole, i, side="right") - 1
        k, n = i - whole[g], count[g]
        place = np.stack([k % n[:, 0], k // n[:, 0] % n[:, 1], k // (n[:, 0] * n[:, 1])], 1) + lo[g]
        mm = origin[g] + place * steps - shift[g]
        p = np.stack([inverse[g, j, 0] * mm[:, 0] + inverse[g, j, 1] * mm[:, 1] + inverse[g, j, 2] * mm[:, 2] for j in range(3)], 1)
        last = dims[g] - 1
        base = np.sign(p) * np.floor(np.abs(p) + 0.5) if method == "nearest" else np.floor(p)
        q = np.clip(base.astype(np.int64), 0, last)
        mine = ((p > -EDGE) & (p < last + EDGE) & (q // tile == corner[g] // tile)).all(1)
        g, place, p, q, last = g[mine], place[mine], p[mine], q[mine], last[mine]
        local = q - corner[g]
        if method == "nearest":
            v = cubes[(g, *local.T)]
        else:
            share, low = p - np.floor(p), np.floor(p) < 0
            other = np.where(low, q, np.minimum(q + 1, last)) - corner[g]  # outside both corners are the edge
            v = np.zeros(len(g))
            for c in itertools.product((0, 1), repeat=3):
                pick = np.array(c, bool)
                v += np.where(pick, share, 1 - share).prod(1) * cubes[(g, *np.where(pick, other, local).T)]
        out.append(pd.DataFrame({"scan_id": head["scan_id"].to_numpy()[g], "x": place[:, 0], "y": place[:, 1], "z": place[:, 2], "_v": v}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"scan_id": head["scan_id"][:0], **{c: [] for c in (*AXES, "_v")}})


def reslice(df: DataFrame, scans: DataFrame, voxel_size: tuple[float, float, float], method: str = "trilinear", background: float | None = None, tile: int = 16, value: str = "v") -> DataFrame:
    """Volumes on the grid of target_grid: scan_id, x, y, z, value of every target voxel.

    method is "trilinear" or "nearest". A target whose place is more than EDGE
    outside the source gets the background: a number, or by default the mean of
    the scan's first and last voxel. At the edges coordinates are clamped.
    Source voxels that are not there, null or not finite count as 0. A scan
    without an entry in scans is dropped. A source voxel is sent to its own
    tile and, on a tile's border, to those that need it; targets inside are
    made where their tile is, those outside where their scan's header is, so
    that no target is sent anywhere.
    """
    if method not in ("trilinear", "nearest"):
        raise ValueError("the method is trilinear or nearest")
    grid, inverse = target_grid(scans, voxel_size), _inverse()
    grid = grid.where("scan_id is not null").withColumns({"inverse": F.array(*[inverse[i][j] for i in range(3) for j in range(3)]), "shift": F.array(*[_entry(i, 3) for i in range(3)])})
    headers = ["origin", "new_dims", "dims", "inverse", "shift"]
    keys = ["scan_id", "tx", "ty", "tz"]

    source = df.select("scan_id", *[F.col(a).alias(f"s{a}") for a in AXES], F.col(value).cast("double").alias("_v")).where("sx is not null and sy is not null and sz is not null")
    tiles = grid.select("scan_id", *headers)
    for i, a in enumerate(AXES):  # a tile holds its voxels and the first ones of the next, and has one row with its scan's header
        own = F.floor(F.col(f"s{a}") / tile).cast("int")
        source = source.withColumn(f"t{a}", F.explode(F.when((F.col(f"s{a}") % tile == 0) & (F.col(f"s{a}") > 0), F.array(own - 1, own)).otherwise(F.array(own))))
        tiles = tiles.withColumn(f"t{a}", F.explode(F.sequence(F.lit(0), F.floor((F.col("dims")[i] - 1) / tile).cast("int")))).withColumn(f"s{a}", F.lit(None).cast("int"))
    rows = source.unionByName(tiles.withColumn("_v", F.lit(None).cast("double")), allowMissingColumns=True)
    kind = dict(scans.dtypes)["scan_id"]

    def solve(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        cuts = np.searchsorted(group, range(0, group[-1] + 257, 256))  # at most 256 tiles at once
        each = [_tile_values(rows[lo:hi].reset_index(drop=True), group[lo:hi] - group[lo], voxel_size, method, tile) for lo, hi in zip(cuts, cuts[1:]) if lo < hi]
        return pd.concat(each, ignore_index=True)

    found = map_groups(rows, keys, solve, f"scan_id {kind}, x int, y int, z int, _v double")

    if background is None:
        first = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)
        last = (F.col("x") == F.col("dims")[0] - 1) & (F.col("y") == F.col("dims")[1] - 1) & (F.col("z") == F.col("dims")[2] - 1)
        ends = df.join(scans.select("scan_id", "dims"), "scan_id").where(first | last).select("scan_id", (F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)) * F.when(first & last, 2).otherwise(1)).alias("_e"))
        level = ends.groupBy("scan_id").agg((F.sum("_e") / 2).alias("_v"))
        outside = grid.join(level, "scan_id", "left").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    else:
        outside = grid.withColumn("_v", F.lit(float(background)))
    for i, a in enumerate(AXES):
        outside = outside.withColumn(a, F.explode(F.sequence(F.lit(0), F.col("new_dims")[i] - 1)))
    mm = [F.col("origin")[i] + F.col(a) * float(s) - F.col("shift")[i] for i, (a, s) in enumerate(zip(AXES, voxel_size))]
    inside = F.lit(True)
    for i in range(3):
        p = F.col("inverse")[3 * i] * mm[0] + F.col("inverse")[3 * i + 1] * mm[1] + F.col("inverse")[3 * i + 2] * mm[2]
        inside = inside & (p > -EDGE) & (p < F.col("dims")[i] - 1 + EDGE)
    outside = outside.where(~inside).select("scan_id", *AXES, "_v")
    return found.unionByName(outside).withColumnRenamed("_v", value)

"""Operators on the voxel grid: windows along axes and joins with neighbours."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelspark.operators.signals import shares

AXES = ("x", "y", "z")


def _line(axis: str) -> Window:
    return Window.partitionBy("scan_id", *[a for a in AXES if a != axis]).orderBy(axis)


def neighbour(axis: str, step: int, value: str = "v") -> Column:
    """The value `step` voxels on; null where that voxel is not there (also in holes)."""
    w = _line(axis)
    at, v = F.lead(axis, step).over(w), F.lead(value, step).over(w)
    return F.when(at == F.col(axis) + step, v)


def axis_diff(df: DataFrame, axis: str, order: int = 1, spacing: float = 1.0, value: str = "v") -> DataFrame:
    """First (forward) or second differences along an axis; null at edges and holes."""
    if order == 1:
        d = (neighbour(axis, 1, value) - F.col(value)) / spacing
    else:
        d = (neighbour(axis, 1, value) - 2 * F.col(value) + neighbour(axis, -1, value)) / (spacing * spacing)
    return df.withColumn("diff", d)


def local_minima(df: DataFrame, value: str = "v") -> DataFrame:
    """Strict minima among direct neighbours; of equal neighbours the one further on wins."""
    low = F.lit(True)
    for axis in AXES:
        low = low & F.coalesce(neighbour(axis, 1, value) - F.col(value) > 0, F.lit(True)) & F.coalesce(F.col(value) - neighbour(axis, -1, value) <= 0, F.lit(True))
    return df.withColumn("_low", low).where("_low").drop("_low")


def neighbour_join(df: DataFrame, offsets: list[tuple[int, int, int]], value: str = "v") -> DataFrame:
    """Each voxel with the values at the given offsets: rows (key, value, dx, dy, dz, neighbour)."""
    moved = df.select("scan_id", *AXES, F.col(value).alias("neighbour"), F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"d{a}") for a, o in zip(AXES, off)]) for off in offsets])).alias("o"))
    moved = moved.select("scan_id", *[(F.col(a) - F.col(f"o.d{a}")).alias(a) for a in AXES], *[F.col(f"o.d{a}").alias(f"d{a}") for a in AXES], "neighbour")
    return df.join(moved, ["scan_id", *AXES])


def map_groups(df: DataFrame, keys: list[str], solve: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """solve(rows, group) for batches of whole groups: group numbers the groups of a batch, whose rows stand together.

    One shuffle on the keys, which must not be null. A batch is an Arrow batch
    and what was left of the group that the one before ended in, so many small
    groups are one call and a task holds no more than a batch and a group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for pdf in itertools.chain(batches, [None]):
            if pdf is not None and not len(pdf):
                continue
            if pdf is not None:
                last = np.logical_and.reduce([(pdf[k] == pdf[k].iloc[-1]).to_numpy() for k in keys])
                begin = len(last) - int(last.sum())  # rows are sorted: the last group is the end
                if begin == 0 and (not held or all(held[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys)):
                    held.append(pdf)
                    continue
                held, ready = [pdf.iloc[begin:]], [*held, pdf.iloc[:begin]]
            else:
                ready = held
            if ready:
                rows = pd.concat(ready, ignore_index=True) if len(ready) > 1 else ready[0].reset_index(drop=True)
                new = np.logical_or.reduce([rows[k].to_numpy()[1:] != rows[k].to_numpy()[:-1] for k in keys])
                yield solve(rows, np.concatenate([[0], np.cumsum(new)]))

    return df.repartition(shares(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def full_minima(df: DataFrame, value: str = "v", tile: int = 16) -> DataFrame:
    """Voxels below all of their 26 neighbours (ties as in local_minima).

    A voxel is sent to its tile and, on a tile's border, to those beside it: no
    rows for pairs. A null value neither beats nor loses; NaN is the largest.
    """
    columns, at = df.columns, ["scan_id", *AXES]
    known = F.lit(True)
    for c in at:
        known = known & F.col(c).isNotNull()
    rows = df.where(known).withColumn("_none", F.col(value).isNull())
    for a in AXES:
        rows = rows.withColumn(f"_t{a}", F.explode(F.array_distinct(F.array(*[F.floor((F.col(a) + i) / tile) for i in (0, -1, 1)]))))
    side = tile + 2

    def lowest(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        local = [rows[a].to_numpy() - rows[f"_t{a}"].to_numpy() * tile + 1 for a in AXES]
        own = np.logical_and.reduce([(i >= 1) & (i <= tile) for i in local])
        place = ((group * side + local[2]) * side + local[1]) * side + local[0]
        v, none = rows[value].to_numpy(float), rows["_none"].to_numpy(bool)
        there = np.flatnonzero(~none)
        there = there[np.lexsort((v[there], place[there]))]  # of several at one place the smallest comes first
        places, values = place[there], v[there]
        mine = np.flatnonzero(own)
        for d in itertools.product((-1, 0, 1), repeat=3):
            if d == (0, 0, 0) or not len(places):
                continue
            to, w = place[mine] + (d[0] * side + d[1]) * side + d[2], v[mine]
            i = np.minimum(np.searchsorted(places, to), len(places) - 1)
            u = values[i]
            less = (u < w) | (np.isnan(w) & ~np.isnan(u))
            if d > (0, 0, 0):
                less |= (u == w) | (np.isnan(w) & np.isnan(u))
            mine = mine[~((places[i] == to) & less & ~none[mine])]
        return rows.iloc[np.sort(mine)][columns]

    low = map_groups(rows, ["scan_id", *[f"_t{a}" for a in AXES]], lowest, df.schema)
    return low.unionByName(df.where(~known))


def gauss_blur(df: DataFrame, sigmas: tuple[float, float, float], value: str = "v") -> DataFrame:
    """Separable truncated Gaussian; the kernel is renormalised over the voxels that are there."""
    for axis, sigma in zip(AXES, sigmas):
        if sigma <= 0:
            continue
        radius = max(1, math.floor(3.5 * sigma))
        top, below = F.lit(0.0), F.lit(0.0)
        near = F.collect_list(F.struct(axis, value)).over(_line(axis).rangeBetween(-radius, radius))
        weight = lambda p: F.exp(-(p[axis] - F.col(axis)) * (p[axis] - F.col(axis)) / (2 * sigma * sigma))  # noqa: B023, E731
        df = df.withColumn("_near", near)
        top = F.aggregate("_near", F.lit(0.0), lambda s, p: s + weight(p) * p[value])  # noqa: B023
        below = F.aggregate("_near", F.lit(0.0), lambda s, p: s + weight(p))  # noqa: B023
        df = df.withColumn(value, top / below).drop("_near")
    return df


def tv_penalty(df: DataFrame, offset: float = 1.0, value: str = "v") -> DataFrame:
    """Per scan: sum of sqrt(offset^2 + squared forward and backward differences) - offset."""
    total = F.lit(offset * offset)
    for axis in AXES:
        for step in (1, -1):
            d = F.coalesce(neighbour(axis, step, value) - F.col(value), F.lit(0.0))
            total = total + d * d
    return df.select("scan_id", (F.sqrt(total) - offset).alias("p")).groupBy("scan_id").agg(F.sum("p").alias("penalty"))


def laplacian_penalty(df: DataFrame, value: str = "v") -> DataFrame:
    """Per scan: half the sum of squared Laplacians; a missing neighbour mirrors the voxel."""
    lap = F.lit(0.0)
    for axis in AXES:
        lap = lap + F.coalesce(neighbour(axis, 1, value), F.col(value)) - 2 * F.col(value) + F.coalesce(neighbour(axis, -1, value), F.col(value))
    return df.select("scan_id", lap.alias("l")).groupBy("scan_id").agg((F.sum(F.col("l") * F.col("l")) / 2).alias("penalty"))


def gradient_penalty(df: DataFrame, weight: float = 1.0, value: str = "v") -> DataFrame:
    """Per scan: weighted sum of squared central differences over inner voxels of each axis."""
    total = F.lit(0.0)
    for axis in AXES:
        g = F.coalesce((neighbour(axis, 1, value) - neighbour(axis, -1, value)) / 2, F.lit(0.0))
        total = total + g * g
    return df.select("scan_id", total.alias("g")).groupBy("scan_id").agg((weight * F.sum("g")).alias("penalty"))


def bounding_box(df: DataFrame, condition: str = "v > 0") -> DataFrame:
    return df.where(condition).groupBy("scan_id").agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def min_max(df: DataFrame, value: str = "v") -> DataFrame:
    return df.groupBy("scan_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def resample(df: DataFrame, targets: DataFrame, value: str = "v") -> DataFrame:
    """Trilinear values at positions (scan_id, id, px, py, pz): eight corners joined by voxel; positions off the grid have none."""
    corner = F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"o{a}") for a, o in zip(AXES, off)]) for off in itertools.product((0, 1), repeat=3)]))
    t = targets.select("scan_id", "id", "px", "py", "pz", corner.alias("o"))
    weight = F.lit(1.0)
    for a in AXES:
        frac = F.col(f"p{a}") - F.floor(f"p{a}")
        weight = weight * F.when(F.col(f"o.o{a}") == 1, frac).otherwise(1 - frac)
    t = t.select("scan_id", "id", *[(F.floor(f"p{a}") + F.col(f"o.o{a}")).cast("int").alias(a) for a in AXES], weight.alias("w")).where("w > 0")
    out = t.join(df.select("scan_id", *AXES, F.col(value).alias("_v")), ["scan_id", *AXES], "left").groupBy("scan_id", "id").agg(F.sum(F.col("w") * F.col("_v")).alias("v"), F.sum("w").alias("_t"), F.sum(F.when(F.col("_v").isNotNull(), F.col("w"))).alias("_h"))
    return out.where("_h > _t - 1e-9").select("scan_id", "id", "v")


def concat_padded(parts: list[DataFrame], axis: str, sizes: dict[str, int]) -> DataFrame:
    """Volumes put one behind the other along an axis; voxels that a part lacks are 0."""
    out, offset = None, 0
    for part in parts:
        grid = part.select("scan_id").distinct()
        for a in AXES:
            grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(sizes[a] - 1))))
        full = grid.join(part, ["scan_id", *AXES], "left").select("scan_id", *AXES, F.coalesce("v", F.lit(0.0)).alias("v")).withColumn(axis, F.col(axis) + offset)
        out, offset = (full if out is None else out.unionByName(full)), offset + sizes[axis]
    return out


def halo_blocks(df: DataFrame, size: int, overlap: int, border: int = 0) -> DataFrame:
    """Rows of each voxel in every block that holds it (with a halo of `border`): columns bx, by, bz."""
    step = size - overlap
    for a in AXES:
        lo = F.greatest(F.lit(0), F.ceil((F.col(a) - size - border + 1) / step)).cast("int")
        hi = F.floor((F.col(a) + border) / step).cast("int")
        df = df.withColumn(f"b{a}", F.explode(F.sequence(lo, hi)))
    return df


def reorient_ras(df: DataFrame, scans: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Voxels with x, y, z turned to run right, anterior and superior: axes permuted and flipped, no resampling.

    scans has a row per scan: scan_id, affine (rows x, y, z of four doubles,
    one array of 12) and dims (array of 3). A voxel axis belongs to the world
    axis that it follows most. A scan whose other components exceed
    `tolerance` of that axis's length, or with two voxel axes on one world
    axis, is an error. Voxels of scans that are not in `scans` are dropped.
    """
    entry = lambda i, j: F.col("affine")[4 * i + j]
    length = [F.sqrt(sum((entry(i, j) * entry(i, j) for i in range(3)), F.lit(0.0))) for j in range(3)]
    main = [F.array_position(F.array(*[F.abs(entry(i, j)) for i in range(3)]), F.greatest(*[F.abs(entry(i, j)) for i in range(3)])).cast("int") - 1 for j in range(3)]
    plan = scans.select("scan_id", "affine", "dims", F.array(*main).alias("axis"), F.array(*length).alias("length"))
    skew = F.lit(False)
    for i, j in itertools.product(range(3), range(3)):
        skew = skew | ((F.col("axis")[j] != i) & (F.abs(entry(i, j)) > tolerance * F.col("length")[j]))
    bad = skew | F.exists("length", lambda v: ~(v > 0)) | (F.size(F.array_distinct("axis")) < 3)
    # for each world axis: the voxel axis along it, whether that runs backwards, and its last index
    source = [F.array_position("axis", F.lit(i)).cast("int") - 1 for i in range(3)]
    back = [F.get("affine", source[i] + 4 * i) < 0 for i in range(3)]
    turns = F.array(*[F.struct(source[i].alias("j"), back[i].alias("back"), (F.get("dims", source[i]) - 1).cast("int").alias("last")) for i in range(3)])
    plan = plan.select("scan_id", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("the axes of a scan are too oblique"))).otherwise(turns).alias("_turns"))
    at = [F.get(F.array(*AXES), F.col("_turns")[i]["j"]) for i in range(3)]
    new = [F.when(F.col("_turns")[i]["back"], F.col("_turns")[i]["last"] - at[i]).otherwise(at[i]).cast("int") for i in range(3)]
    return df.join(plan, "scan_id").withColumns(dict(zip(AXES, new))).drop("_turns")


def frequency_window(n: int, width: float, kind: str) -> np.ndarray:
    """Weights of the n frequencies of an axis, lowest (most negative) first.

    width is the largest frequency kept; for "gauss" it is the standard
    deviation of the blur in voxels.
    """
    k = np.arange(n) - n // 2
    r = np.abs(k) / width
    if kind == "gauss":
        return np.exp(-2 * (math.pi * width * k / n) ** 2)
    if kind == "staircase":  # the step that a frequency is on: the largest whole m <= width with |k| < width / m
        top = math.floor(width)
        m = np.array([top if a == 0 else min(top, math.ceil(1 / a) - 1) for a in r])
        return np.where(m >= 1, np.cos(math.pi / (np.maximum(m, 1) + 1)), 0.0)
    shapes = {"lukosz": lambda: np.cos(math.pi * r / (r + 1)), "boxcar": lambda: np.ones(n), "triangular": lambda: 1 - r}
    if kind not in shapes:
        raise ValueError(f"unknown window {kind!r}")
    return np.where(r <= 1, shapes[kind](), 0.0)


def apodize(df: DataFrame, size: tuple[int, int], width: tuple[float, float], kind: str = "gauss", sigma_z: float = 0.0, by: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """Magnitude of each slice after a window in frequency space, then a blur along z where sigma_z > 0.

    A slice is (scan_id, z) and the columns of `by` (a volume number, say), at
    most size[0] by size[1] voxels, so a group is one image. Voxels that are
    not there, null or not finite count as 0; the result has the rows of df.
    sigma_z needs one volume for each scan_id. Returns scan_id, x, y, z, `by`
    and the value.
    """
    if sigma_z > 0 and by:
        raise ValueError("blur each volume by itself")
    weights = np.fft.ifftshift(np.outer(frequency_window(size[0], width[0], kind), frequency_window(size[1], width[1], kind)))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        image = np.zeros(size)
        image[x, y] = np.nan_to_num(rows[value].to_numpy(dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
        return rows.assign(**{value: np.abs(np.fft.ifft2(np.fft.fft2(image) * weights))[x, y]})

    rows = df.select("scan_id", *AXES, *by, F.col(value).cast("double").alias(value))
    out = rows.groupBy("scan_id", "z", *by).applyInPandas(one, rows.schema)
    return gauss_blur(out, (0, 0, sigma_z), value) if sigma_z > 0 else out


def spectral_matrix(n: int, new: int, shift: float = 0.0, compensate: bool = False) -> np.ndarray:
    """Real matrix (new, n) that resamples a periodic line by its spectrum.

    Frequencies are cut off or filled with zeros. An even length has one line
    for its highest frequency: it is split in two halves when the line gets
    longer, and both parts meet in it when the new length is even and shorter.
    shift moves the line to higher positions, in old samples. compensate makes
    up for linear interpolation on the new samples.
    """
    k = np.arange(n)
    signed = np.where(k < (n + 1) // 2, k, k - n)
    f = np.fft.fft(np.eye(n), axis=0) * np.exp(-2j * np.pi * signed * shift / n)[:, None]
    if compensate:
        with np.errstate(divide="ignore"):
            weight = 1 / np.sinc(np.minimum(k, n - k) / new) ** 2
        f = f * np.where(np.isfinite(weight), weight, 0)[:, None]
    out = np.zeros((new, n), complex)
    short = min(n, new)
    for q in range(-((short - 1) // 2), (short - 1) // 2 + 1):
        out[q % new] = f[q % n]
    if short % 2 == 0:
        h = short // 2
        if new > n:
            out[h], out[-h] = f[h] / 2, f[h] / 2
        elif new < n:
            out[h] = f[h] + f[-h]
        else:
            out[h] = f[h]
    return (np.fft.ifft(out, axis=0) * (new / n)).real


def fft_resample(df: DataFrame, size: tuple[int, int, int], new: tuple[int, int, int], shift: tuple[float, float, float] = (0.0, 0.0, 0.0), compensate: bool = False, by: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """Volumes of `size` voxels on a grid of `new` voxels, axis by axis; see spectral_matrix.

    An axis that keeps its size and is not shifted is left alone. Lines, not
    volumes, are gathered: one shuffle for each changed axis, and a batch of
    lines is one matrix product. Voxels that are not there, null or not finite
    count as 0. Returns scan_id, x, y, z, `by` and the value, for all lines
    that hold a voxel.
    """
    rows = df.select("scan_id", *AXES, *by, F.col(value).cast("double").alias(value))
    for a, n, m, s in zip(AXES, size, new, shift):
        if n == m and s == 0:
            continue
        matrix = spectral_matrix(n, m, s, compensate and n != m)
        others = [c for c in rows.columns if c not in (a, value)]
        lines = rows.groupBy(*others).agg(F.collect_list(F.struct(a, value)).alias("_line"))
        of = F.map_from_entries("_line")
        line = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(of, i), F.lit(0.0)))  # noqa: B023
        types = dict(rows.dtypes)

        def turned(batches, matrix=matrix, others=others):
            for pdf in batches:
                if len(pdf):
                    data = np.nan_to_num(np.stack(pdf["_line"].to_numpy()).astype(float), nan=0.0, posinf=0.0, neginf=0.0)
                    yield pdf[others].assign(_line=list(data @ matrix.T))

        lines = lines.select(*others, line.alias("_line")).mapInPandas(turned, ", ".join([*[f"`{c}` {types[c]}" for c in others], "_line array<double>"]))
        rows = lines.select(*others, F.posexplode("_line").alias(a, value))
    return rows.select("scan_id", *AXES, *by, value)

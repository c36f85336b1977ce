"""Geometry of scans from header rows, and the grid that a scan was measured on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import AXES, spectral_matrix


def _once(df: DataFrame) -> DataFrame:
    """df worked out here: what stands above is not merged into it."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def _median(values: Column) -> Column:
    """Median of an array of doubles."""
    ordered, n = F.sort_array(values), F.size(values)
    return (F.get(ordered, ((n - 1) / 2).cast("int")) + F.get(ordered, (n / 2).cast("int"))) / 2


def _column_step(k: int) -> Column:
    """Component k of the median step between slice positions."""
    at = F.transform("positions", lambda p: F.get(p, F.lit(k)))
    return _median(F.zip_with(F.slice(at, F.lit(2), F.size(at) - 1), F.slice(at, F.lit(1), F.size(at) - 1), lambda b, a: b - a))


def _pixel(k: int) -> Column:
    """Mean of spacing k over the slices; an error if it differs by a thousandth."""
    at = F.transform("spacings", lambda p: F.get(p, F.lit(k)))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = add(at) / F.size(at)
    spread = F.sqrt(add(F.transform(at, lambda v: (v - mean) * (v - mean))) / F.greatest(F.lit(1), F.size(at) - 1))
    return F.when(F.coalesce(F.size("spacings"), F.lit(0)) <= 0, 1.0).when(spread < 0.001 * mean, mean).otherwise(F.raise_error(F.lit("pixel spacing differs between the slices of a scan")))


def scan_affine(headers: DataFrame) -> DataFrame:
    """(scan_id, affine): rows x, y, z of the world, four doubles each, for voxel indices from 0.

    headers has a row per scan: scan_id; spacings (pairs, one for each slice or
    one; null or empty: 1); orientation (two vectors, or three with that of the
    slices); positions (of slices, the first at least); locations of slices;
    between, the stated spacing between slices; mosaic; normal. locations,
    between, mosaic and normal may be null. Voxel axis x follows the second
    vector (rows of the image), y the first.

    The slice distance is `between` where it is stated or the image is a
    mosaic, else the step between the first two locations, else 0. The slice
    direction is the third vector; else the median step between positions,
    which is taken as it is where its length is within 5 % of that distance or
    none is stated; else `normal`, or the cross product of the two vectors.
    """
    o = lambda i, k: F.get("orientation", F.lit(3 * i + k))
    cross = [o(0, (k + 1) % 3) * o(1, (k + 2) % 3) - o(0, (k + 2) % 3) * o(1, (k + 1) % 3) for k in range(3)]
    located = F.when(F.size("locations") > 1, F.get("locations", F.lit(1)) - F.get("locations", F.lit(0))).otherwise(0.0)
    stated = F.coalesce("mosaic", F.lit(False)) | F.col("between").isNotNull()
    rows = _once(headers).select(
        "scan_id", "orientation", F.get("positions", F.lit(0)).alias("first"), "between", "normal", F.array(_pixel(0), _pixel(1)).alias("pixel"), F.when(stated, F.col("between")).otherwise(located).alias("distance"),
        F.when(F.size("positions") > 1, F.array(*[_column_step(k) for k in range(3)])).alias("step"),
    )
    rows = _once(rows)
    length = F.sqrt(sum((F.get("step", F.lit(k)) * F.get("step", F.lit(k)) for k in range(3)), F.lit(0.0)))
    walked = F.col("step").isNotNull() & (F.col("between").isNull() | (F.abs(length - F.col("distance")) < 0.05 * F.col("distance")))
    given = F.col("step").isNotNull() & F.col("normal").isNotNull()
    third = [
        F.when(F.size("orientation") == 9, F.col("distance") * o(2, k)).when(walked, F.get("step", F.lit(k)))
        .otherwise(F.col("distance") * F.when(given, F.get("normal", F.lit(k))).otherwise(cross[k]))
        for k in range(3)
    ]
    pixel = lambda i: F.get("pixel", F.lit(i))
    entries = [e for k in range(3) for e in (pixel(1) * o(1, k), pixel(0) * o(0, k), third[k], F.get("first", F.lit(k)))]
    return rows.select("scan_id", F.array(*entries).alias("affine"))


def acquisition_size(headers: DataFrame) -> DataFrame:
    """headers with `size`, the voxels that a zero-filled scan was measured with, with a margin of 7 %, at most `dims`.

    matrix has four numbers, of which the second and third or the fourth and
    first are given and the others are 0; without any (or null) the axes keep
    their sizes. Slices: a volume measured as one (volumetric) goes by the
    ratio of the spacing between slices to their thickness; else slices that
    are twice as thick as their spacing are halved. Both pairs are an error.
    """
    d = lambda k: F.get("dims", F.lit(k))
    m = lambda k: F.coalesce(F.get("matrix", F.lit(k)), F.lit(0))
    lead, other = (m(1) != 0) | (m(2) != 0), (m(3) != 0) | (m(0) != 0)
    margin = lambda n: F.ceil(n * 1.07 + 0.9).cast("int")
    plane = [F.when(lead & other, F.raise_error(F.lit("an acquisition matrix names both pairs")).cast("int")).when(lead, F.least(d(k), margin(m(a)))).when(other, F.least(d(k), margin(m(b)))).otherwise(d(k)) for k, a, b in ((0, 1, 3), (1, 2, 0))]
    double = F.abs(F.col("thickness") / F.col("between") - 2) < 0.01
    deep = F.when(F.coalesce("volumetric", F.lit(False)) & (F.col("thickness") > 0) & F.col("between").isNotNull(), F.least(d(2), margin(d(2) * F.col("between") / F.col("thickness"))))
    deep = deep.when(~F.coalesce("volumetric", F.lit(False)) & double, F.ceil(d(2) / 2).cast("int")).otherwise(d(2))
    return headers.withColumn("size", F.array(*[c.cast("int") for c in (*plane, deep)]))


def acquisition_affine(scans: DataFrame) -> DataFrame:
    """scans with affine for the grid of `size` instead of `dims`: longer steps, the first voxel stays where it is."""
    step = lambda i: F.when(i % 4 == 3, 1.0).otherwise(F.get("dims", (i % 4).cast("int")) / F.get("size", (i % 4).cast("int")))
    return scans.withColumn("affine", F.transform("affine", lambda v, i: v * step(i)))


def acquisition_grid(df: DataFrame, scans: DataFrame, by: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """Voxels of zero-filled scans on the grid that they were measured on, by their spectra (see spectral_matrix).

    scans has scan_id, dims and size (of acquisition_size). Scans of any sizes
    go together: an axis is one shuffle of lines that carry their lengths, and
    the lines of a batch that share both lengths are one matrix product. Voxels
    that are not there, null or not finite count as 0; scans that are not in
    `scans` are dropped. Returns scan_id, x, y, z, `by` and the value.
    """
    lengths = scans.select("scan_id", F.col("dims").alias("_dims"), F.col("size").alias("_size"))
    rows = df.select("scan_id", *AXES, *by, F.col(value).cast("double").alias(value)).join(lengths, "scan_id")
    for k, axis in enumerate(AXES):
        others = [c for c in rows.columns if c not in (axis, value)]
        types = dict(rows.dtypes)
        lines = rows.groupBy(*others).agg(F.collect_list(F.struct(axis, value)).alias("_line"))
        of = F.map_from_entries("_line")
        line = F.transform(F.sequence(F.lit(0), F.get("_dims", F.lit(k)) - 1), lambda i: F.coalesce(F.element_at(of, i), F.lit(0.0)))  # noqa: B023

        def turned(batches, k=k, others=others):
            known = {}
            for pdf in batches:
                new = np.array([s[k] for s in pdf["_size"]], int)
                old = pdf["_line"].str.len().to_numpy(int)
                out = np.empty(len(pdf), object)
                for n, m in set(zip(old.tolist(), new.tolist())):
                    which = np.flatnonzero((old == n) & (new == m))
                    data = np.nan_to_num(np.stack(pdf["_line"].to_numpy()[which]).astype(float), nan=0.0, posinf=0.0, neginf=0.0)
                    if n != m:
                        if (n, m) not in known:
                            known[n, m] = spectral_matrix(n, m)
                        data = data @ known[n, m].T
                    for i, row in zip(which, data):
                        out[i] = row
                yield pdf[others].assign(_line=out)

        lines = lines.select(*others, line.alias("_line")).mapInPandas(turned, ", ".join([*[f"`{c}` {types[c]}" for c in others], "_line array<double>"]))
        rows = lines.select(*others, F.posexplode("_line").alias(axis, value))
    return rows.select("scan_id", *AXES, *by, value)

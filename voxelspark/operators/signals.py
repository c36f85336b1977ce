"""Voxel rows: masks, joins with protocol and fields, log-linear tensor fit, noise and levels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("scan_id", "x", "y", "z")
EPS = 2.220446049250313e-16


def pack(dwi_long: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Long form to one row per voxel with its signal in order of measurement."""
    rows = dwi_long.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("m", "s"))).alias("_p"))
    return rows.select(*key, F.transform("_p", lambda p: p["s"]).alias("signal"))


def shares(spark: SparkSession) -> int:
    """Tasks that a solve is dealt to: the session's number of shuffle partitions, four for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt to tasks by their columns before a solve.

    Tasks are cut by bytes, but a voxel's solve costs far more time than its
    bytes tell: a table in one small file, or shuffled parts that were merged,
    would leave all of it to a few tasks. The number of tasks stands.
    """
    return df.repartition(shares(df.sparkSession), *[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])


def expand_volumes(dwi: DataFrame, volumes: list[int] | None = None) -> DataFrame:
    """One row per voxel and (selected) volume."""
    out = dwi.select(*[c for c in dwi.columns if c != "signal"], F.posexplode("signal").alias("m", "s"))
    return out if volumes is None else out.where(F.col("m").isin(volumes))


def collapse_scans(volumes: DataFrame, key: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Single-volume rows (path, value s) to one signal per voxel, ordered by path."""
    return volumes.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("path", "s"))).alias("_p")).select(*key, F.transform("_p", lambda p: p["s"]).alias("signal"))


def mask_voxels(dwi: DataFrame, mask: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Voxels whose mask is set."""
    return dwi.join(mask.where("mask").select(*key), list(key), "left_semi")


def single_slice(dwi: DataFrame, nz: int) -> DataFrame:
    """The centre slice (number nz // 2, counted from one)."""
    return dwi.where(F.col("z") == nz // 2 - 1)


def clamp_signal(s: Column, mean: Column) -> Column:
    """Not positive to the smallest step of a double, then at least a hundredth of the voxel's mean."""
    return F.greatest(F.when(s <= 0, EPS).otherwise(s), mean / 100)


def patch_invalid(s: Column) -> Column:
    """Not finite or not positive becomes 1."""
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")) | (s <= 0), 1.0).otherwise(s)


def with_protocol(dwi_long: DataFrame, protocol: DataFrame) -> DataFrame:
    """Every measurement meets its b-value and gradient; a protocol has a row per volume."""
    return dwi_long.join(F.broadcast(protocol), "m")


def with_fields(dwi: DataFrame, fields: DataFrame, n: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """Per-voxel inputs; zeros where a voxel has none."""
    return dwi.join(fields.select(*key, "f"), list(key), "left").withColumn("f", F.coalesce("f", F.array(*[F.lit(0.0)] * n)))


def clip_box(df: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """Voxels within lo..hi (inclusive), with coordinates counted from lo."""
    for axis, a, b in zip("xyz", lo, hi):
        df = df.where(F.col(axis).between(a, b)).withColumn(axis, F.col(axis) - a)
    return df


def flip_axis(df: DataFrame, axis: str, size: int) -> DataFrame:
    return df.withColumn(axis, F.lit(size - 1) - F.col(axis))


def design(rows: list[tuple]) -> np.ndarray:
    """Design matrix (measurements x 7) of a tensor and the log signal at b=0."""
    b, g = np.array([r[1] for r in rows]), np.array([r[2:5] for r in rows])
    x, y, z = g.T
    return np.column_stack([-b * x * x, -b * y * y, -b * z * z, -2 * b * x * y, -2 * b * x * z, -2 * b * y * z, np.ones_like(b)])


def log_linear_operator(rows: list[tuple]) -> np.ndarray:
    """Weighted least-squares operator (7 x measurements): constant for a protocol."""
    a = design(rows)
    w = np.exp(-2e-3 * np.abs(a[:, :3].sum(1)))
    aw = a * w[:, None]
    return np.linalg.solve(aw.T @ aw, aw.T * w)


def log_linear_tensor_fit(dwi_long: DataFrame, rows: list[tuple], key: tuple[str, ...] = ("scan_id", "vox")) -> DataFrame:
    """Per voxel: dt (6 entries), s0, s0_fit, noise (residual deviation with n - 7 degrees of freedom).

    s0 is the mean of the b=0 measurements where there are any. One shuffle by
    voxel; all sums are taken in one aggregation.
    """
    spark = dwi_long.sparkSession
    op, a, n = log_linear_operator(rows), design(rows), len(rows)
    table = spark.createDataFrame([(i, *op[:, i].tolist(), bool(r[1] == 0), *a[i, :6].tolist()) for i, r in enumerate(rows)], "m int, " + ", ".join(f"p{k} double" for k in range(7)) + ", b0 boolean, " + ", ".join(f"q{k} double" for k in range(6)))
    packed = dwi_long.groupBy(*key).agg(F.avg("s").alias("mean"), F.collect_list(F.struct("m", "s")).alias("_p"))
    rows_ = packed.select(*key, "mean", F.explode("_p").alias("p")).select(*key, "mean", "p.m", "p.s").join(F.broadcast(table), "m")
    y = F.ln(clamp_signal(F.col("s"), F.col("mean")))
    fit = rows_.groupBy(*key).agg(*[F.sum(F.col(f"p{k}") * y).alias(f"t{k}") for k in range(7)], F.avg(F.when(F.col("b0"), F.col("s"))).alias("s0_mean"), F.collect_list(F.struct("s", *[f"q{k}" for k in range(6)])).alias("_r"))
    s0_fit = F.exp("t6")
    s0 = F.coalesce("s0_mean", s0_fit)

    def residual(r: Column) -> Column:
        e = F.lit(0.0)
        for k in range(6):
            e = e + r[f"q{k}"] * F.col(f"t{k}")
        return s0 * F.exp(e) - r["s"]

    rss = F.aggregate("_r", F.lit(0.0), lambda acc, r: acc + residual(r) * residual(r))
    return fit.select(*key, F.array(*[f"t{k}" for k in range(6)]).alias("dt"), s0.alias("s0"), s0_fit.alias("s0_fit"), F.sqrt(rss / (n - 7)).alias("noise"))


def global_levels(fit: DataFrame) -> DataFrame:
    """Per scan: exact medians of noise and s0, and their ratio."""
    return fit.groupBy("scan_id").agg(F.median("noise").alias("noise"), F.median("s0").alias("signal")).withColumn("snr", F.col("signal") / F.col("noise"))


def with_global_levels(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Levels of a voxel's scan: one row per scan, joined by scan."""
    return df.join(levels.select("scan_id", F.col("noise").alias("noise_level"), F.col("signal").alias("signal_level")), "scan_id")


def drop_low_signal(fit: DataFrame, levels: DataFrame) -> DataFrame:
    """Voxels with s0 of at least their scan's noise."""
    return with_global_levels(fit, levels).where("s0 >= noise_level").drop("noise_level", "signal_level")


def normalise_signal(df: DataFrame, levels: DataFrame, columns: list[str]) -> DataFrame:
    """Columns divided by their scan's signal level (kept as signal_level, to undo)."""
    out = with_global_levels(df, levels)
    return out.withColumns({c: F.col(c) / F.col("signal_level") for c in columns}).drop("noise_level")


def noise_per_measurement(residuals: DataFrame, n_measurements: int) -> DataFrame:
    """Slice-wise residual deviation of each measurement (rows scan_id, z, m, r), then the median over slices."""
    per = residuals.groupBy("scan_id", "z", "m").agg(F.sum(F.col("r") * F.col("r")).alias("ss"), F.count("*").alias("n"))
    per = per.withColumn("noise", F.sqrt(F.col("ss") / (F.greatest("n", F.lit(1)) * (1 - 7 / n_measurements))))
    return per.groupBy("scan_id", "m").agg(F.median("noise").alias("noise"))


def noise_from_residue(fits: DataFrame, n_measurements: int, n_parameters: int) -> DataFrame:
    """Per scan: median-based and mean-based noise of rows with rss."""
    dof = n_measurements - n_parameters
    return fits.groupBy("scan_id").agg(F.median(F.sqrt(F.col("rss") / dof)).alias("by_median"), F.sqrt(F.sum("rss") / (F.count("*") * dof)).alias("by_mean"))


def global_noise(fits: DataFrame, option: str | float, n_measurements: int, n_parameters: int, levels: DataFrame | None = None) -> DataFrame:
    """Noise level of each scan (scan_id, noise) for a maximum-likelihood fit.

    option: "logtensor" takes the level of the log-linear fit (`levels`, see
    global_levels), "lsqmodel" the median of sqrt(rss / (N - parameters)) over
    the voxels of `fits`, and a number (or its text) is that number.
    """
    if option == "logtensor":
        if levels is None:
            raise ValueError("logtensor needs the levels of the log-linear fit")
        return levels.select("scan_id", "noise")
    if option == "lsqmodel":
        return fits.groupBy("scan_id").agg(F.median(F.sqrt(F.col("rss") / (n_measurements - n_parameters))).alias("noise"))
    try:
        number = float(option)
    except ValueError:
        raise ValueError("the noise level is logtensor, lsqmodel or a number") from None
    return fits.select("scan_id").distinct().withColumn("noise", F.lit(number))


def select_best(candidates: DataFrame, key: list[str], by: str = "rss") -> DataFrame:
    """Per voxel the candidate (column start) with the smallest rss or largest loglik; ties keep the earlier start."""
    value = F.col(by) if by == "rss" else -F.col(by)
    rest = [c for c in candidates.columns if c not in key]
    best = candidates.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(F.coalesce(F.nanvl(value, F.lit(float("inf"))), F.lit(float("inf"))), "start")).alias("_b"))
    return best.select(*key, "_b.*")


def keep_best_starts(candidates: DataFrame, key: list[str], n: int) -> DataFrame:
    """The n starts of each voxel with the smallest objective."""
    w = Window.partitionBy(*key).orderBy("objective", "start")
    return candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def thin_sample(df: DataFrame, key: list[str], step: int = 7, n: int = 100) -> DataFrame:
    """Every step-th of the first n voxels of each scan."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy("scan_id").orderBy(*key)))
    return first.where((F.col("_r") <= n) & ((F.col("_r") - 1) % step == 0)).drop("_r")


def union_starts(*starts: DataFrame) -> DataFrame:
    """Candidate starts stacked, numbered by place."""
    out = None
    for i, s in enumerate(starts):
        s = s.withColumn("start", F.lit(i))
        out = s if out is None else out.unionByName(s)
    return out


def stick_order(df: DataFrame, first: list[str], second: list[str], f1: str, f2: str) -> DataFrame:
    """Swaps the columns of two compartments where the second has the larger fraction."""
    swap = F.col(f1) < F.col(f2)
    return df.withColumns({a: F.when(swap, F.col(b)).otherwise(F.col(a)) for x, y in zip(first, second) for a, b in ((x, y), (y, x))})


def min_edit_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left name the smallest unit-cost edit distance to a right name, and the first such name.

    Both sides are lists of names; the right one is broadcast only up to 100,000
    names, beyond that Spark pairs blocks of both.
    """
    right = right.select(F.col("name").alias("other")).distinct()
    if right.limit(100_001).count() <= 100_000:
        right = F.broadcast(right)
    pairs = left.select("name").distinct().crossJoin(right).withColumn("d", F.levenshtein("name", "other"))
    return pairs.groupBy("name").agg(F.min("d").alias("distance"), F.min_by("other", F.struct("d", "other")).alias("nearest"))

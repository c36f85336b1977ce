"""Deterministic voxel tables derived by Spark from the star-schema tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.functions.columns import angles_to_unit


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def protocol_rows(shells: tuple[float, ...] = (1000.0,)) -> list[tuple[int, float, float, float, float]]:
    """Three b=0 measurements and 25 spiral directions for each shell."""
    out = [(m, 0.0, 0.0, 0.0, 0.0) for m in range(3)]
    for b in shells:
        for k in range(25):
            z = 1 - (k + 0.5) / 25
            r, phi = math.sqrt(1 - z * z), k * 2.399963229728653
            out.append((len(out), b, r * math.cos(phi), r * math.sin(phi), z))
    return out


def protocol(spark: SparkSession, shells: tuple[float, ...] = (1000.0,)) -> DataFrame:
    return spark.createDataFrame(protocol_rows(shells), "m int, b double, gx double, gy double, gz double")


def voxel_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One voxel for each part, with the parameters of a ball and one stick."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    k = F.col("p_partkey").cast("bigint")
    j = F.floor(k / 5)
    return p.select(
        (k % 5).alias("scan_id"), k.alias("vox"), (j % 5).cast("int").alias("x"), (F.floor(j / 5) % 5).cast("int").alias("y"), F.floor(j / 25).cast("int").alias("z"),
        F.col("p_retailprice").cast("double").alias("s0"), ((0.8 + (F.col("p_size") - 1) / 49 * 1.4) * 1e-3).alias("d"), (0.2 + 0.5 * ((7 * k) % 61) / 60).alias("fiso"),
        (0.2 + 1.2 * ((13 * k) % 37) / 36).alias("th"), (-3 + 6 * ((17 * k) % 41) / 40).alias("ph"), F.col("p_size").alias("size"),
    )


def dwi_long(spark: SparkSession, sf_dir: str, shells: tuple[float, ...] = (1000.0,), perturbed: bool = True) -> DataFrame:
    """Ball-and-stick signal of each voxel and measurement; perturbed by up to one per cent."""
    t = voxel_truth(spark, sf_dir).crossJoin(F.broadcast(protocol(spark, shells)))
    v = angles_to_unit(F.col("th"), F.col("ph"))
    g = F.col("gx") * v[0] + F.col("gy") * v[1] + F.col("gz") * v[2]
    s = F.col("s0") * ((1 - F.col("fiso")) * F.exp(-F.col("b") * F.col("d") * g * g) + F.col("fiso") * F.exp(-F.col("b") * F.col("d")))
    if perturbed:
        s = s * (1 + 0.01 * F.sin(12.9898 * F.col("vox") + 78.233 * F.col("m")))
    return t.select("scan_id", "vox", "x", "y", "z", "m", s.alias("s"))


def _normal(*of: Column) -> tuple[Column, Column]:
    """Two independent normal numbers that follow from the columns."""
    u = [(F.pmod(F.xxhash64(F.lit(k), *of), F.lit(1 << 40)) + 0.5) / (1 << 40) for k in (1, 2)]
    r = F.sqrt(-2 * F.ln(u[0]))
    return r * F.cos(2 * math.pi * u[1]), r * F.sin(2 * math.pi * u[1])


def rician(dwi_long: DataFrame, sigma: Column) -> DataFrame:
    """Magnitudes of the signal with complex noise of that level; the same at every run."""
    real, imaginary = _normal(F.col("vox").cast("bigint"), F.col("m").cast("bigint"))
    s = F.col("s") + sigma * real
    return dwi_long.withColumn("s", F.sqrt(s * s + sigma * sigma * imaginary * imaginary))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4x4x4 voxels of each embedding."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("scan_id"), F.posexplode("embedding").alias("i", "v"))
    i = F.col("i")
    return e.select("scan_id", (i % 4).cast("int").alias("x"), (F.floor(i / 4) % 4).cast("int").alias("y"), F.floor(i / 16).cast("int").alias("z"), F.col("v").cast("double").alias("v"))

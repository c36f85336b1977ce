"""Scan files and header tables as DataFrames."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numpy types of the file format's data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
_HEADER = "path string, dim array<int>, pixdim array<double>, datatype int, bitpix int, vox_offset double, scl_slope double, scl_inter double, qform int, sform int, quatern array<double>, qoffset array<double>, srow array<double>"


def _parse(data: bytes) -> dict:
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    g = lambda fmt, at: struct.unpack_from(order + fmt, data, at)
    return {
        "order": order, "dim": list(g("8h", 40)), "datatype": g("h", 70)[0], "bitpix": g("h", 72)[0], "pixdim": [float(x) for x in g("8f", 76)], "vox_offset": float(g("f", 108)[0]),
        "scl_slope": float(g("f", 112)[0]), "scl_inter": float(g("f", 116)[0]), "qform": g("h", 252)[0], "sform": g("h", 254)[0], "quatern": [float(x) for x in g("3f", 256)], "qoffset": [float(x) for x in g("3f", 268)], "srow": [float(x) for x in g("12f", 280)],
    }


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def read_scan_headers(spark: SparkSession, glob: str) -> DataFrame:
    """One row per file: dims, spacing, type, scaling and geometry."""
    names = [c.split()[0] for c in _HEADER.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p, **_parse(_plain(bytes(c))[:352])} for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, _HEADER)


def read_scans(spark: SparkSession, glob: str, slices: list[int] | None = None, volumes: list[int] | None = None) -> DataFrame:
    """One row per voxel: path, x, y, z, signal (unscaled). Only the slices and volumes asked for are turned into rows, a slice at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                raw = _plain(bytes(content))
                h = _parse(raw[:352])
                nx, ny, nz, nt = (max(1, h["dim"][i]) if i <= h["dim"][0] else 1 for i in (1, 2, 3, 4))
                data = np.frombuffer(raw, np.dtype(TYPES[h["datatype"]]).newbyteorder(h["order"]), nx * ny * nz * nt, int(h["vox_offset"])).reshape(nt, nz, ny, nx)
                for z in range(nz) if slices is None else slices:
                    part = data[:, z] if volumes is None else data[volumes, z]
                    y, x = np.mgrid[:ny, :nx]
                    yield pd.DataFrame({"path": path, "x": x.ravel(), "y": y.ravel(), "z": z, "signal": list(part.reshape(len(part), -1).T.astype(float))})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string, x int, y int, z int, signal array<double>")


def scan_frames(headers: DataFrame) -> DataFrame:
    return headers.select("path", F.when(F.get("dim", F.lit(0)) >= 4, F.get("dim", F.lit(4))).otherwise(1).alias("frames"))


def apply_intensity_scaling(voxels: DataFrame, headers: DataFrame) -> DataFrame:
    """slope * value + inter where the slope is not 0; one header per file."""
    scale = headers.select("path", "scl_slope", "scl_inter")
    on = F.col("scl_slope") != 0
    out = voxels.join(scale, "path", "left").withColumn("signal", F.when(on, F.transform("signal", lambda v: v * F.col("scl_slope") + F.col("scl_inter"))).otherwise(F.col("signal")))
    return out.drop("scl_slope", "scl_inter")


def read_protocol(spark: SparkSession, bval: str, bvec: str) -> DataFrame:
    """protocol (m, b, gx, gy, gz) of two text files; wide or tall."""

    def numbers(path: str) -> DataFrame:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda l: F.trim(l) != "")).alias("r", "line"))
        return lines.select("r", F.posexplode(F.split(F.trim(F.translate("line", "\t\r,", "   ")), " +")).alias("c", "v")).select("r", "c", F.col("v").cast("double").alias("v"))

    b, g = numbers(bval), numbers(bvec)
    wide = g.agg((F.max("c") > F.max("r")).alias("wide"))
    m, k = F.when(F.col("wide"), F.col("c")).otherwise(F.col("r")), F.when(F.col("wide"), F.col("r")).otherwise(F.col("c"))
    g = g.crossJoin(F.broadcast(wide)).select(m.alias("m"), k.alias("k"), "v").groupBy("m").pivot("k", [0, 1, 2]).agg(F.first("v"))
    return b.select(F.greatest("r", "c").alias("m"), F.col("v").alias("b")).join(g, "m").select("m", "b", F.col("0").alias("gx"), F.col("1").alias("gy"), F.col("2").alias("gz"))


def write_maps(maps: DataFrame, path: str, by: tuple[str, ...] = ("scan_id",)) -> None:
    maps.write.mode("overwrite").partitionBy(*by).parquet(path)


def export_nifti(voxels: DataFrame, directory: str, shape: tuple[int, int, int], value: str = "v") -> DataFrame:
    """One float32 volume per scan, zero where no voxel is; returns a manifest (scan_id, path, voxels).

    A scan is one bounded volume and is written by one task; directory is a
    folder that all executors share.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros(shape[::-1], "<f4")
        data[pdf["z"], pdf["y"], pdf["x"]] = pdf[value]
        head = bytearray(352)
        struct.pack_into("<i", head, 0, 348)
        struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
        struct.pack_into("<2h", head, 70, 16, 32)
        struct.pack_into("<8f", head, 76, *[1.0] * 8)
        struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
        head[344:348] = b"n+1\0"
        path = f"{directory}/scan_{pdf['scan_id'].iloc[0]}.nii.gz"
        with gzip.open(path, "wb") as f:
            f.write(bytes(head) + data.tobytes())
        return pd.DataFrame({"scan_id": [pdf["scan_id"].iloc[0]], "path": [path], "voxels": [len(pdf)]})

    return voxels.select("scan_id", "x", "y", "z", value).groupBy("scan_id").applyInPandas(run, "scan_id long, path string, voxels long")


def series_catalog(headers: DataFrame) -> DataFrame:
    """Per series: images, first and last instance, slice positions, description."""
    return headers.groupBy("series").agg(F.count("*").alias("images"), F.min("instance").alias("first"), F.max("instance").alias("last"), F.countDistinct("pos").alias("positions"), F.min("description").alias("description"))


def order_series(headers: DataFrame) -> DataFrame:
    """Images of a series numbered by instance, then position, then description."""
    return headers.withColumn("number", F.row_number().over(Window.partitionBy("series").orderBy("instance", "pos", "description")))


def split_volumes(headers: DataFrame) -> DataFrame:
    """Slice index (rank of position) and volume index (place among the images of that position)."""
    slice_ = F.dense_rank().over(Window.partitionBy("series").orderBy("pos")) - 1
    vol = F.row_number().over(Window.partitionBy("series", "pos").orderBy("instance", "description")) - 1
    return headers.withColumns({"slice": slice_, "volume": vol})


def select_series(catalog: DataFrame, numbers: list[int] | None = None, name: str | None = None, regex: list[str] | None = None) -> DataFrame:
    """By number, by a description that must be unique, or by any of several patterns (with the first that fits)."""
    if numbers is not None:
        return catalog.where(F.col("series").isin(numbers))
    if name is not None:
        found = catalog.where(F.col("description") == name)
        if found.limit(2).count() != 1:
            raise ValueError(f"{name} is not one series")
        return found
    fits = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(regex or []))):
        fits = F.when(F.col("description").rlike(r), i).otherwise(fits)
    return catalog.withColumn("pattern", fits).where("pattern is not null")

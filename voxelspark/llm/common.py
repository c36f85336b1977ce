"""Shared folder, bounded bitmaps and connected components for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only where that setting is unset and the master is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete results of table() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df does not have in any case."""
    own, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in own:
            name = f"_{name}"
        own.add(name.lower())
        out.append(name)
    return out


#: Longs of a row of a bitmap: a row costs the driver far more than a long does.
LANES = 8


def hit_words(keys: DataFrame, key: Column, log2_words: int = 18) -> DataFrame:
    """Bitmap of 64 * 2**log2_words hashed keys as rows (word, m0 to m7), broadcast: an eighth of that many rows at most, whatever the input.

    A join with it keeps every row that has a partner, and few others; it
    skips rows only, so a full bitmap costs time and never changes a result.
    """
    slot = F.xxhash64(key)
    bits = keys.select(_word(slot, log2_words).alias("word"), _lane(slot).alias("lane"), _mask(slot).alias("mask"))
    masks = [F.bit_or(F.when(F.col("lane") == i, F.col("mask")).otherwise(0)).alias(f"m{i}") for i in range(LANES)]
    return F.broadcast(bits.groupBy("word").agg(*masks))


def may_hit(df: DataFrame, words: DataFrame, key: Column, log2_words: int = 18, outside: bool = False) -> DataFrame:
    """Rows of df whose key may be in hit_words(); with outside the others."""
    slot, names = F.xxhash64(key), df.columns
    own = fresh(df, *words.columns)
    words = words.toDF(*own)
    mask = F.lit(0).cast("bigint")
    for i in reversed(range(LANES)):
        mask = F.when(_lane(slot) == i, F.col(own[1 + i])).otherwise(mask)
    found = (F.col(own[0]) == _word(slot, log2_words)) & (mask.bitwiseAND(_mask(slot)) != 0)
    return df.join(F.broadcast(words), found, "left_anti" if outside else "left_semi").select(*[F.col(f"`{c.replace('`', '``')}`") for c in names])


def _word(slot: Column, log2_words: int) -> Column:
    return F.shiftright(slot, 9).bitwiseAND(F.lit((1 << max(log2_words - 3, 0)) - 1))


def _lane(slot: Column) -> Column:
    return F.shiftright(slot, 6).bitwiseAND(F.lit(LANES - 1))


def _mask(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))


def documents(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id as bigint and text as string; a null text is empty. keys: bigint columns that are kept."""
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keys)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bitmap(df: DataFrame, key: Column, log2_bits: int) -> Broadcast:
    """Broadcast bitmap of 64-bit keys, of 2**log2_bits bits whatever the input.

    The keys are or-ed together by Spark; the driver gets at most
    2**log2_bits / 64 pairs. It is used to skip rows only, so a full bitmap
    costs time and never changes a result.
    """
    bits = df.select(F.pmod(key, F.lit(1 << log2_bits)).alias("b")).select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("m"))
    rows = bits.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(1 << (log2_bits - 6), np.int64)
    words[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return df.sparkSession.sparkContext.broadcast(words.view(np.uint64))


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in the bitmap."""
    b = keys & np.uint64(len(words) * 64 - 1)
    return (words[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) != 0


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest reachable id of each node of links(a, b): rows (node, component).

    Alternates large-star and small-star rounds; each is two joins and two
    aggregations whose hubs are pre-aggregated, and is written to the shared
    folder. Ends when a round changes nothing.
    """
    e = table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("u"), "v")
    return e.unionByName(roots).groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")

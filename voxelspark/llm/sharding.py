"""Sharding: size-tiered compaction of small immutable shards (DataFrame operations only).

Every arrival is written as one small shard and never changed. Runs of `fan`
shards in the same size tier (powers of `fan` of the smallest size) are merged
into target-sized files. Each step ends with a new manifest version: one file
that lists the live shards, written aside and renamed to its number, which
fails if another writer has taken it. That step is atomic where the file
system renames in one step (HDFS, and a local disk between processes that
check first); on an object store commits need one writer at a time. A writer states the version it started
from; whoever is late reads the newer version and tries again, so nothing that
another writer added is lost. Superseded shards stay until vacuum() finds them
old and named by none of the kept versions: readers of those versions go on.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read, shared_folder

_MANIFEST = "shard string, tier int, docs long, bytes long, files long"
_TRIES = 100


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/manifest")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[1:9]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))


def newest(spark: SparkSession, root: str) -> int:
    """Number of the last version, 0 before the first."""
    return (versions(spark, root) or [0])[-1]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Live shards of a version (the newest by default): shard, tier, docs, bytes, files."""
    version = newest(spark, root) if version is None else version
    if not version:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/v{version:08d}.parquet")


def commit(spark: SparkSession, live: list[tuple], root: str, base: int) -> int:
    """Publish a manifest as version base + 1; FileExistsError if another writer has taken that number."""
    aside = f"{root}/aside/{shared_folder(spark).rsplit('/', 1)[1]}"
    spark.createDataFrame(live, _MANIFEST).coalesce(1).write.parquet(aside)  # a few dozen bytes for each shard
    fs, folder = _fs(spark, aside)
    part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    _, target = _fs(spark, f"{root}/manifest/v{base + 1:08d}.parquet")
    fs.mkdirs(target.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    never = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    never[0] = hadoop.Options.Rename.NONE  # an existing target is an error
    try:
        hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(part, target, never)
    except Exception as e:
        if fs.exists(target):
            raise FileExistsError(str(target)) from e
        raise
    finally:
        fs.delete(folder, True)
    return base + 1


def _tier(size: int, smallest: int, fan: int) -> int:
    return max(0, int(math.log(max(size, 1) / smallest, fan)))


def _described(spark: SparkSession, root: str, name: str, schema, tier: int) -> tuple:
    """Row of the manifest of a written shard."""
    path = f"{root}/shards/{name}"
    fs, p = _fs(spark, path)
    files = [s.getLen() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
    return name, tier, spark.read.schema(schema).parquet(path).count(), sum(files), len(files)


def _add(spark: SparkSession, rows: list[tuple], root: str) -> int:
    for _ in range(_TRIES):
        base = newest(spark, root)
        try:
            return commit(spark, [tuple(r) for r in manifest(spark, root, base).collect()] + rows, root, base)
        except FileExistsError:
            continue
    raise RuntimeError(f"{_TRIES} other writers came first")


def append(df: DataFrame, root: str, smallest: int = 1 << 20, fan: int = 4) -> int:
    """Add an arrival as a new shard; returns the manifest version."""
    spark, name = df.sparkSession, shared_folder(df.sparkSession).rsplit("/", 1)[1]
    df.write.option("compression", "zstd").parquet(f"{root}/shards/{name}")
    row = _described(spark, root, name, df.schema, 0)
    return _add(spark, [(name, _tier(row[3], smallest, fan), *row[2:])], root)


def append_dealt(df: DataFrame, root: str, rows: int, smallest: int = 1 << 20, fan: int = 4) -> int:
    """Add df as arrivals of `rows` rows at most, a shard each, by one pass over df without a shuffle; returns the manifest version.

    Every partition of df is cut into its own arrivals, whatever the layout of
    its files: there are as many as df has rows for, and at most one shorter
    one for each partition.
    """
    spark, name = df.sparkSession, shared_folder(df.sparkSession).rsplit("/", 1)[1]
    number, batch = fresh(df, "number", "batch")
    place = F.monotonically_increasing_id()  # the partition, then 33 bits of the row in it
    dealt = df.withColumn(number, place).withColumn(batch, F.concat_ws("-", F.shiftright(number, 33), F.floor(F.col(number).bitwiseAND(F.lit((1 << 33) - 1)) / rows)))
    dealt.drop(number).write.partitionBy(batch).option("compression", "zstd").parquet(f"{root}/shards/{name}")
    fs, p = _fs(spark, f"{root}/shards/{name}")
    parts = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    found = [_described(spark, root, f"{name}/{part}", df.schema, 0) for part in sorted(parts)]
    return _add(spark, [(r[0], _tier(r[3], smallest, fan), *r[2:]) for r in found], root)


def compact(spark: SparkSession, root: str, schema, target_bytes: int = 128 << 20, smallest: int = 1 << 20, fan: int = 4, age_s: float | None = None) -> int:
    """Merge runs of `fan` shards of one tier until no tier has so many; returns the manifest version.

    The driver handles one row per shard, never rows of data. A merge whose
    shards another writer has merged meanwhile is dropped. With age_s, what is
    superseded and older than that goes after each merge, and with it all
    versions but the newest: only for a root that nobody else uses.
    """
    while True:
        tiers: dict[int, list] = {}
        for s in manifest(spark, root).collect():
            tiers.setdefault(s.tier, []).append(s)
        run = next((sorted(v, key=lambda s: (s.bytes, s.shard))[:fan] for _, v in sorted(tiers.items()) if len(v) >= fan), None)
        if run is None:
            return newest(spark, root)
        size, gone = sum(s.bytes for s in run), {s.shard for s in run}
        merged = spark.read.schema(schema).parquet(*[f"{root}/shards/{s.shard}" for s in run])
        name = shared_folder(spark).rsplit("/", 1)[1]
        # files are read together, without a shuffle
        merged.coalesce(max(1, math.ceil(size / target_bytes))).write.option("compression", "zstd").parquet(f"{root}/shards/{name}")
        row = _described(spark, root, name, schema, max(run[0].tier + 1, _tier(size, smallest, fan)))
        if row[2] != sum(s.docs for s in run):
            raise RuntimeError("a merged shard does not hold the rows of its run")
        for _ in range(_TRIES):
            base = newest(spark, root)
            live = [tuple(s) for s in manifest(spark, root, base).collect()]
            if not gone <= {s[0] for s in live}:
                break
            try:
                commit(spark, [s for s in live if s[0] not in gone] + [row], root, base)
                break
            except FileExistsError:
                continue
        if age_s is not None:
            vacuum(spark, root, 1, age_s)


def vacuum(spark: SparkSession, root: str, keep: int = 4, age_s: float = 86_400) -> int:
    """Delete shards older than age_s that none of the newest `keep` versions names, and the older manifests; returns how many shards.

    A shard is younger than age_s while an append that has yet to commit it is
    running: age_s must exceed the longest append.
    """
    found = versions(spark, root)
    fs, p = _fs(spark, f"{root}/shards")
    named = {s.shard for v in found[-keep:] for s in manifest(spark, root, v).collect()}
    for v in found[:-keep]:
        fs.delete(_fs(spark, f"{root}/manifest/v{v:08d}.parquet")[1], False)
    count, limit = 0, (time.time() - age_s) * 1000
    _, aside = _fs(spark, f"{root}/aside")
    for s in fs.listStatus(aside) if fs.exists(aside) else []:  # of writers that were lost while they committed
        if s.getModificationTime() < limit:
            fs.delete(s.getPath(), True)
    for s in fs.listStatus(p) if fs.exists(p) else []:
        inner = [x for x in fs.listStatus(s.getPath()) if x.isDirectory()]
        top = s.getPath().getName()
        for x, name in [(x, f"{top}/{x.getPath().getName()}") for x in inner] or [(s, top)]:
            if name not in named and x.getModificationTime() < limit:
                fs.delete(x.getPath(), True)
                count += 1
    return count


def shards(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """Rows of all live shards of a version (the newest by default), with the shard and tier they are in."""
    live = manifest(spark, root, version)
    names = [r.shard for r in live.collect()]
    if not names:
        return spark.createDataFrame([], schema).withColumns({"shard": F.lit(""), "tier": F.lit(0)}).limit(0)
    rows = spark.read.schema(schema).parquet(*[f"{root}/shards/{s}" for s in names])
    rows = rows.withColumn("shard", F.regexp_extract(F.input_file_name(), "/shards/(.+)/[^/]+$", 1))
    return rows.join(F.broadcast(live.select("shard", "tier")), "shard")  # fan shards a tier at most


def shard_documents(docs: DataFrame, root: str, arrivals: int = 16, target_bytes: int = 128 << 20, smallest: int = 1 << 20, fan: int = 4, age_s: float | None = None) -> DataFrame:
    """Append docs as `arrivals` batches (one more for each partition at most), compact, and return all rows with shard and tier.

    All columns of docs are kept; columns of docs named shard or tier are not
    allowed. Null keys, texts of any length and repeated rows are rows like
    any other. An empty table makes no shards. What is superseded stays for
    readers of older versions until vacuum() is called, or see age_s of
    compact().
    """
    if clash := {"shard", "tier"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns that sharding adds: {sorted(clash)}")
    spark = docs.sparkSession
    append_dealt(docs, root, max(1, math.ceil(docs.count() / arrivals)), smallest, fan)
    compact(spark, root, docs.schema, target_bytes, smallest, fan, age_s)
    return shards(spark, root, docs.schema)


def _bytes_of(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = read(spark, sf_dir, "documents"), shared_folder(spark)
    arrivals = max(16, math.ceil(_bytes_of(spark, f"{sf_dir}/documents.parquet") / (64 << 20)))
    out = shard_documents(docs, root, arrivals, age_s=0)  # its own root: no other reader
    live = manifest(spark, root).collect()
    # a commit for the arrivals and one for each merge: 16 arrivals take five merges, the last one of the second tier
    merged = F.lit(newest(spark, root) >= 6), F.lit(max((s.tier for s in live), default=0) >= 2)
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars", merged[0].alias("five_merges"), merged[1].alias("two_tiers"))


ORACLE = "SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars, true AS five_merges, true AS two_tiers FROM documents"

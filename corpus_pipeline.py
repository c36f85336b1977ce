"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
as they are after it; the last returns the encoded documents. Extra columns of
docs go through; null doc_ids and null texts are kept as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm.common import fresh, hit_words, may_hit, read, shared_folder, table
from voxelspark.llm.decontamination import leaks
from voxelspark.llm.line_dedup import line_dedup
from voxelspark.llm.minhash_dedup import near_dedup
from voxelspark.llm.sentencepiece_scan import encode_digests
from voxelspark.llm.toxicity import toxicity


def _keyed(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """docs with a 128-bit key of doc_id and text, nulls included, and its names: rows of one key get the same decisions."""
    of = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))]
    keys = fresh(docs, "k1", "k2")
    return docs.withColumns({k: F.xxhash64(F.lit(i), *of) for i, k in enumerate(keys)}), tuple(keys)


def _without(keyed: DataFrame, gone: DataFrame, keys: tuple[str, str], columns: list[str]) -> DataFrame:
    """Rows of keyed whose key is not in gone; only rows that may be in it are shuffled."""
    gone = table(gone.select(*keys).distinct())
    words, first = hit_words(gone, F.col(keys[0])), F.col(keys[0])
    clean = may_hit(keyed, words, first, outside=True)
    return clean.unionByName(may_hit(keyed, words, first).join(gone, list(keys), "left_anti")).select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; each row by its own text, whatever its doc_id."""
    keyed, keys = _keyed(docs)
    return _without(keyed, toxicity(keyed, read(spark, sf_dir, "labels"), keys=keys).where("predicted = 1"), keys, docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their later matches of earlier lines."""
    return line_dedup(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest doc_id. Five words, similarity 0.8."""
    keyed, keys = _keyed(docs)
    return _without(keyed, near_dedup(keyed, k=5, num=80, den=100, keys=keys).where("not kept"), keys, docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; each row by its own text, whatever its doc_id."""
    keyed, keys = _keyed(docs)
    return _without(keyed, leaks(keyed, read(spark, sf_dir, "benchmark"), keys=keys), keys, docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded and decoded texts: doc_id, n_ids, ids_sha256, n_chars, text_sha256."""
    return encode_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode_texts),
]

#: No stage but the last can be written in SQL that ends in time; tests/test_pipeline.py holds the stages that drop rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    top = shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{top}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

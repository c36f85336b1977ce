"""Quality classifier: importance resampling of hashed n-gram models.

Two bag models over hashed word 1- and 2-grams are estimated: the target from
labelled good texts, the raw one from all documents. The log ratio of a text,
summed over its n-grams, is its log importance weight; adding Gumbel noise and
taking the k largest draws k documents without replacement in proportion to the
weights. Counts are summed by Spark: each task sends one row per bucket at most.
Only texts that may have a good label are shuffled, to find those that do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hit_words, may_hit, read, table
from .words import lower_ascii, ngram_hashes, text_slices, word_hashes

_U = np.uint64
BUCKETS = 1 << 16


def _features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and of the word pairs from each word (-1 across texts), and each text's first word."""
    h, _, first = word_hashes(lower_ascii(raw), off)
    one = (h & _U(BUCKETS - 1)).astype(np.int64)
    two = np.full(len(h), -1, np.int64)
    if len(h) > 1:
        two[:-1] = (ngram_hashes(h, 2) & _U(BUCKETS - 1)).astype(np.int64)
        last = first[1:][np.diff(first) > 0] - 1
        two[last] = -1
    return one, two, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, raw, off in text_slices(batch.column("text")):
            for f in _features(raw, off)[:2]:
                n += np.bincount(f[f >= 0], minlength=BUCKETS)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["bucket", "n"])


def _counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket is in the texts: BUCKETS numbers, summed by Spark."""
    rows = texts.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BUCKETS)
    n[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return n


def _weigh(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.append(ratio.value, 0.0)
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j, raw, off in text_slices(batch.column("text")):
                one, two, first = _features(raw, off)
                sums = np.concatenate(([0.0], np.cumsum(r[one] + r[two])))
                total[i:j] = sums[first[1:]] - sums[first[:-1]]
                count[i:j] = np.maximum(0, 2 * np.diff(first) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(count), pa.array(total)], ["doc_id", "row_key", "n_features", "log_ratio"])

    return run


def top_k(df: DataFrame, key: str, tie: list[Column], k: int, bins: int = 4096, few: int = 10_000) -> DataFrame:
    """The k rows with the largest keys (finite doubles), ties by `tie`; rows are never sorted together.

    Histograms narrow the border of the k-th row down to a bin of `few` rows at
    most, or of one key; only that bin is sorted.
    """
    lo, hi, total = df.agg(F.min(key), F.max(key), F.count("*")).first()
    if k >= total:
        return df
    above, lo, hi = 0, float(lo), float(hi)
    for _ in range(12):
        inside = df.where((F.col(key) >= lo) & (F.col(key) <= hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        place = F.least(F.lit(bins - 1), F.floor((F.col(key) - lo) / width).cast("int"))
        rows = sorted(inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect(), key=lambda r: -r.b)
        for r in rows:
            if above + r.n >= k:
                break
            above += r.n
        lo, hi = r.lo, r.hi
        if r.n <= few:
            break
    border = df.where((F.col(key) >= lo) & (F.col(key) <= hi)).orderBy(F.col(key).desc(), *tie).limit(k - above)
    return df.where(F.col(key) > hi).unionByName(border)


def _labelled(docs: DataFrame, good: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in good. Ids are shuffled, and of the texts only those that the skip filter cannot tell."""
    key = F.col("doc_id")
    some = may_hit(docs, hit_words(good, key), key)
    wrong = table(some.select("doc_id").distinct().join(good, "doc_id", "left_anti"))
    words = hit_words(wrong, key)
    return may_hit(some, words, key, outside=True).unionByName(may_hit(some, words, key).join(good, "doc_id", "left_semi"))


def quality_sample(docs: DataFrame, labels: DataFrame, fraction: float = 0.5, length: float | None = None, seed: int = 7, smoothing: float = 1.0) -> DataFrame:
    """The drawn documents: doc_id, n_features, log_weight, key, kept (true).

    k is `fraction` of the documents, rounded. log_weight is the sum of the log
    ratios of a text's n-grams, the exact log importance weight; with `length`
    it is tempered to their mean times `length`, so that the size of a text
    counts for nothing. The noise is a hash of doc_id and text: the same rows
    give the same draw. Empty and null texts have weight 1 (log_weight 0).
    Without good labels all weights are 1. Repeated rows are drawn together or
    cut by row at the border, and count as often as they are there, in both
    models; repeated labels count once. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = documents(docs)
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint")).distinct()
    target = _labelled(docs, good)
    raw, wanted = _counts(docs), _counts(target)
    n = np.stack([raw, wanted]) + smoothing
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum()) if wanted.sum() else np.zeros(BUCKETS)
    keyed = docs.withColumn("row_key", F.xxhash64(F.lit(seed), "doc_id", "text"))
    scored = keyed.mapInArrow(_weigh(spark.sparkContext.broadcast(ratio)), "doc_id long, row_key long, n_features long, log_ratio double")
    weight = F.col("log_ratio") if length is None else F.when(F.col("n_features") > 0, F.col("log_ratio") / F.col("n_features") * length).otherwise(0.0)
    uniform = (F.shiftrightunsigned("row_key", 11) + 0.5) / float(1 << 53)
    scored = table(scored.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))
    drawn = top_k(scored, "key", [F.col("doc_id"), F.col("row_key")], round(fraction * scored.count()))
    return drawn.select("doc_id", "n_features", "log_weight", "key", F.lit(True).alias("kept"))


def op2_quality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

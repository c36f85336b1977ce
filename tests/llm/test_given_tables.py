"""Query columns on given tables against direct computation: op2's weights and draw, op8's payload."""

import binascii
import hashlib
import math
import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from pyspark.sql import functions as F

from voxelspark.llm import quality, transport_stream

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@lru_cache(maxsize=None)
def bucket(*words):
    raw = " ".join(words).encode()
    one, two, _ = quality._features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return int(one[0] if len(words) == 1 else two[0])


def grams(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [bucket(w) for w in words] + [bucket(a, b) for a, b in zip(words, words[1:])]


def test_weights_and_draw(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(7), F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit(""))).alias("h")).collect()
    raw, wanted, own = Counter(), Counter(), {}
    for r in rows:
        own[r.doc_id] = grams(r.text)
        raw.update(own[r.doc_id])
        if r.doc_id in good:
            wanted.update(own[r.doc_id])
    n = quality.BUCKETS
    totals = sum(wanted.values()) + n, sum(raw.values()) + n
    ratio = lambda b: math.log((wanted[b] + 1) / totals[0]) - math.log((raw[b] + 1) / totals[1])
    weight = {d: sum(map(ratio, g)) for d, g in own.items()}
    key = {r.doc_id: weight[r.doc_id] - math.log(-math.log((((r.h & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53))) for r in rows}
    drawn = sorted(key, key=lambda d: -key[d])[: round(len(rows) / 2)]
    got = {r.doc_id: r for r in quality.op2_quality_sample(spark, SF).collect()}
    assert set(got) == set(drawn) and len(drawn) > 50
    for d, r in got.items():
        assert r.n_features == len(own[d]) and math.isclose(r.log_weight, weight[d], rel_tol=1e-9, abs_tol=1e-6) and math.isclose(r.key, key[d], rel_tol=1e-9, abs_tol=1e-6)


def test_payload_columns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in transport_stream.op8_transport_stream(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        media, r = transport_stream.mux(payload), got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and transport_stream.demux(media)[0] == payload


def test_toxicity_finds_held_out_labels(spark):
    """At 0.7, on rows that are never learned from: most of the marked documents, and few others."""
    from voxelspark.llm.toxicity import op3_toxicity

    sf = "/root/testdata/sf0.1"
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic in (0, 1)").collect()}
    rows = [(marked[r.doc_id], r.predicted, r.score) for r in op3_toxicity(spark, sf).collect() if r.held_out and r.doc_id in marked]
    hit = sum(t and p for t, p, _ in rows)
    toxic, clean = sum(t for t, _, _ in rows), sum(not t for t, _, _ in rows)
    assert toxic > 100 and hit >= 0.8 * toxic and hit >= 0.8 * sum(p for _, p, _ in rows)
    above = sum(a[2] > b[2] for a in rows if a[0] for b in rows if not b[0])
    assert above >= 0.9 * toxic * clean

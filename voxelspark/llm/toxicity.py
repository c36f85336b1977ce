"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of the character n-grams (bytes, A-Z lowered) of its words
with their borders, hashed into buckets. Each bucket has an embedding; the
average over a span of text goes through a linear softmax of two classes.
Embeddings and softmax are trained together, so an unseen misspelling shares
the vectors of its n-grams. A document is scored by spans of `span` n-gram
starts and takes its highest span, so that a long text does not thin it out.

Learning uses a bounded sample of labelled doc_ids (`per_class` of each class,
by hash order, one text each, of `longest` characters at most); everything else
is one narrow pass over all documents, whole texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, read
from .words import lower_ascii, mix, text_slices

_U = np.uint64
BUCKETS = 1 << 18
NGRAMS = (3, 4, 5)


def ngram_buckets(raw: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that start at each byte of a text, one column for each n; -1 where there is none.

    White space counts as one border byte; an n-gram has borders at its ends only.
    """
    low = lower_ascii(raw)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    low = np.concatenate(([32], np.where(space, np.uint8(32), low), [32] * max(NGRAMS))).astype(np.uint64)
    inner = np.concatenate(([0], np.cumsum(low == 32)))
    n = len(raw) + 1
    out = np.full((n, len(NGRAMS)), -1, np.int32)
    h = np.zeros(n, np.uint64)
    for k in range(max(NGRAMS)):
        h = h * _U(257) + low[k : k + n]
        if k + 1 in NGRAMS:
            good = inner[k : k + n] == inner[1 : n + 1]  # no border inside
            out[:, NGRAMS.index(k + 1)] = np.where(good, (mix(h + _U(k << 56)) & _U(BUCKETS - 1)).astype(np.int32), -1)
    return out


def _spans(n: int, span: int) -> np.ndarray:
    """Span borders over n starts: equal lengths of span at most, half a span at least unless there is one."""
    count = max(1, round(n / span))
    return np.linspace(0, n, count + 1).astype(np.int64)


def span_margins(grams: np.ndarray, first: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    """Average of the table over the n-grams of each span, over `least` n-grams at least.

    grams are rows of ngram_buckets(), first the row at which each span starts.
    """
    good = grams >= 0
    value = np.where(good, table[grams], np.float32(0)).sum(1, dtype=np.float64)
    return np.add.reduceat(value, first) / np.maximum(least, np.add.reduceat(good.sum(1), first))


class Bags:
    """Spans of texts as distinct n-grams with their counts, in two arrays, which go back to the system as a whole."""

    def __init__(self, texts: list[str], span: int) -> None:
        ids, counts, size, ends = [], [], [], [0]
        for t in texts:
            grams = ngram_buckets(np.frombuffer(t.encode(), np.uint8))
            edges = _spans(len(grams), span)
            for a, b in zip(edges[:-1], edges[1:]):
                x = grams[a:b]
                x, n = np.unique(x[x >= 0], return_counts=True)
                ids.append(x)
                counts.append(n.astype(np.float32))
                size.append(len(x))
            ends.append(len(size))
        self.ids, self.counts = np.concatenate(ids), np.concatenate(counts)
        self.edges, self.first, self.last = np.concatenate(([0], np.cumsum(size))), np.array(ends[:-1]), np.array(ends[1:])

    def __len__(self) -> int:
        return len(self.first)

    def part(self, which: np.ndarray) -> Bags:
        """Some of the texts, by the same arrays."""
        out = copy(self)
        out.first, out.last = self.first[which], self.last[which]
        return out

    def spans(self, i: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(buckets, counts) of the spans of text i."""
        cuts = [slice(self.edges[k], self.edges[k + 1]) for k in range(self.first[i], self.last[i])]
        return [(self.ids[c], self.counts[c]) for c in cuts]

    def whole(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, counts) of text i."""
        spans = self.spans(i)
        if len(spans) == 1:
            return spans[0]
        ids, place = np.unique(np.concatenate([x for x, _ in spans]), return_inverse=True)
        return ids, np.bincount(place, np.concatenate([n for _, n in spans])).astype(np.float32)

    def common(self, least: int) -> np.ndarray:
        """Which buckets occur in at least `least` texts."""
        texts = np.zeros(BUCKETS, np.int32)
        for i in range(len(self)):
            texts[self.whole(i)[0]] += 1
        return texts >= least


class SubwordSoftmax:
    """Averaged subword embeddings and a linear softmax of two classes.

    The average is taken over `least` n-grams at least: what a shorter span
    lacks says nothing, so that a few n-grams are weak evidence.
    """

    def __init__(self, dim: int = 8, least: int = 200, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.e = np.zeros((BUCKETS, dim), np.float32)  # an n-gram that was never seen says nothing; the softmax alone breaks the symmetry
        self.w = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.least = least

    @classmethod
    def calibrated(cls, texts: list[str], y: np.ndarray, span: int, folds: int = 3, share: float = 0.1, **options) -> SubwordSoftmax:
        """A model of all texts, calibrated on the margins that models of the other folds give, weighted to `share` of class 1.

        Only with fewer texts of a class than folds its own margins are used, by the same weights.
        """
        bags = Bags(texts, span)
        model = cls().fit(bags, y, **options)
        models, fold = [model], np.zeros(len(y), np.int64)
        if min((y == 0).sum(), (y == 1).sum()) >= folds:
            for c in (0, 1):
                fold[y == c] = np.arange((y == c).sum()) % folds
            models = [cls().fit(bags.part(np.flatnonzero(fold != f)), y[fold != f], **options) for f in range(folds)]
        tables = [part.table() for part in models]
        m = np.zeros(len(y))
        for i, t in enumerate(texts):
            grams = ngram_buckets(np.frombuffer(t.encode(), np.uint8))
            m[i] = models[fold[i]]._margins(grams, _spans(len(grams), span), tables[fold[i]]).max()
        model.shift, model.slope = _calibrate(m, y, np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y))
        return model

    def fit(self, bags: Bags, y: np.ndarray, steps: int = 15_000, rate: float = 3.0, scale: float = 20.0, common: int = 3, damping: float = 0.1, seed: int = 2) -> SubwordSoftmax:
        """Adagrad over documents, about `steps` of them in 5 to 12 epochs.

        All of a text learns its label in the first epoch, later the span that
        speaks most for class 1 (by a table renewed every 50 documents).
        """
        rng = np.random.default_rng(seed)
        # n-grams of fewer than `common` texts are left out: they would only tell these texts apart
        often = bags.common(common)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        self.scale = np.float32(scale)
        g2 = np.full(BUCKETS, damping, np.float32)  # large: evidence adds up by text instead of each first step being as large
        gw, gb = np.full_like(self.w, 1e-8), np.full_like(self.b, 1e-8)
        for epoch in range(min(12, max(5, steps // len(y)))):
            for turn, d in enumerate(rng.permutation(len(y))):
                if turn % 50 == 0:
                    table = self.table()
                if epoch:
                    spans = bags.spans(d)
                    ids, part = spans[int(np.argmax([table[x] @ n / max(self.least, n.sum()) for x, n in spans]))] if len(spans) > 1 else spans[0]
                else:
                    ids, part = bags.whole(d)
                part = part / max(self.least, part.sum())
                good = often[ids]
                ids, part = ids[good], part[good]
                if not len(ids):
                    continue
                e = self.e[ids]
                mean = np.einsum("i,ij->j", part, e) * self.scale  # too small a product for threads
                z = mean @ self.w + self.b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[int(y[d])] -= 1
                g = p * np.float32(weight[d])
                ge = (self.w @ g) * self.scale
                dw = np.outer(mean, g)
                gw += dw * dw
                gb += g * g
                self.w -= 0.1 * dw / np.sqrt(gw)
                self.b -= 0.1 * g / np.sqrt(gb)
                # the step of an n-gram is its part times ge
                sums = g2[ids] + part * part * (ge * ge).mean()
                g2[ids] = sums
                self.e[ids] = e - (np.float32(0.1 * rate) * part / np.sqrt(sums))[:, None] * ge
        return self

    def table(self) -> np.ndarray:
        """What each bucket adds to the margin of class 1."""
        return (self.e @ (self.w[:, 1] - self.w[:, 0])) * self.scale

    @property
    def bias(self) -> float:
        return float(self.b[1] - self.b[0])

    def _margins(self, ids: np.ndarray, edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        return span_margins(ids, edges[:-1], table, self.least) + self.bias


def _calibrate(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Shift and slope: a logistic curve of the margins, moved until 0.7 is where the weighted F1 is highest.

    Of the cuts within 0.01 of the highest F1 the median is taken.
    """
    _, slope = _logistic(m, y, weight)
    order = np.argsort(-m, kind="stable")
    hit, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + hit[-1])
    low = m[order]
    cut = np.append((low[:-1] + low[1:]) / 2, low[-1])
    f1[:-1][low[:-1] == low[1:]] = 0
    best = np.median(cut[f1 >= f1.max() - 0.01])
    slope = max(slope, 1e-3)
    return float(np.log(0.7 / 0.3) - slope * best), slope


def _logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic calibration of margins: Newton steps, halved until the loss falls."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    x = np.stack([np.ones_like(m), m])
    ridge = np.diag([1e-6, 1e-3])

    def loss(c: np.ndarray) -> float:
        z = c @ x
        return float(weight @ (np.logaddexp(0, z) - t * z) + c @ ridge @ c / 2)

    c, step = np.array([0.0, 1.0]), np.ones(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(c @ x, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + ridge, x @ (weight * (p - t)) + ridge @ c)
        now = loss(c)
        while loss(c - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        c = c - step
        if np.abs(step).max() < 1e-6:
            break
    return float(c[0]), float(c[1])


def sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int = 1 << 16) -> DataFrame:
    """(doc_id, text, toxic) of at most per_class labelled doc_ids of each class whose crc32(doc_id) mod 3 is not 1.

    A doc_id counts once, with the label of most of its rows; as many of both
    leave it out. Of several texts the smallest is taken. Texts of more than
    `longest` characters are not learned from: the driver gets 2 * per_class *
    longest characters at most.
    """
    rows = labels.where("toxic in (0, 1) and doc_id is not null").where("crc32(cast(cast(doc_id as bigint) as string)) % 3 <> 1")
    rows = rows.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.sum(2 * F.col("toxic").cast("int") - 1).alias("votes"))
    rows = rows.where("votes <> 0").select("doc_id", (F.col("votes") > 0).cast("int").alias("toxic"))
    parts = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    some = documents(docs).where(F.length("text") <= longest).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    return some.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, span: int = 2000) -> SubwordSoftmax | None:
    """Model from sample(); None without both classes."""
    some = sample(docs, labels, per_class).toPandas().sort_values("doc_id")
    y = some["toxic"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    return SubwordSoftmax.calibrated(some["text"].tolist(), y, span)


def _score(model, span: int, keys: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias, least, shift, slope = model.value
        for batch in batches:
            ids, score = batch.column("doc_id"), np.empty(batch.num_rows)
            for i, j, raw, off in text_slices(batch.column("text")):
                # one n-gram pass for the slice; a text's borders are put between texts
                glued = np.full(len(raw) + j - i, 32, np.uint8)
                at = off[:-1] + np.arange(j - i)
                glued[np.arange(len(raw)) + np.repeat(np.arange(j - i), np.diff(off))] = raw
                grams = ngram_buckets(glued)
                edges = [_spans(int(n) + 1, span)[:-1] + a for n, a in zip(np.diff(off), at)]
                first = np.cumsum([0, *[len(e) for e in edges]])[:-1]
                score[i:j] = np.maximum.reduceat(span_margins(grams, np.concatenate(edges), table, least), first) + bias
            out = 1 / (1 + np.exp(-np.clip(shift + slope * score, -30, 30)))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(out), *[batch.column(k) for k in keys]], ["doc_id", "score", *keys])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, span: int = 2000, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.7).

    Null texts count as empty; an empty text has the score of no evidence. A
    null doc_id is never held out. Without labels of both classes every score
    is 0. Only doc_id and text of docs are used, and doc_id in no score; keys
    names bigint columns that are carried.
    """
    docs = documents(docs, *keys)
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    model = train(docs, labels, per_class, span)
    if model is None:
        scored = docs.select("doc_id", F.lit(0.0).alias("score"), *keys)
    else:
        parts = (model.table(), model.bias, model.least, model.shift, model.slope)
        scored = docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(parts), span, keys), "".join(["doc_id long, score double", *[f", {k} long" for k in keys]]))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), *keys)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

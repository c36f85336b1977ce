"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A benchmark item is the multiset of its shingles of `k` lower-cased words. A
window of a document has the item's number of words. Windows that share no
shingle with any item can't be similar, so only windows over a shared shingle
get a 64-bit fingerprint (each shingle votes with its weight, its
multiplicity). Fingerprints are cut into radius + 1 blocks: two within the
radius agree on a block at least, so looking up the blocks finds all of them.
What is within the radius is confirmed by the weighted Jaccard similarity,
sum of smaller over sum of larger multiplicities. A text with fewer words than
the item is one window as a whole; items for it are looked up by its rarest
shingles, which misses none.

A benchmark of at most `block_words` words is broadcast. A larger one is dealt
into blocks on Spark and never passes the driver: documents that share a
shingle with it (by a bitmap of fixed size) meet each block in tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, documents, in_bitmap, read, table
from .words import lower_ascii, mix, ngram_hashes, text_slices, word_hashes

_U = np.uint64
PART_CHARS = 32 << 20


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes."""
    bits = (shingles[..., None] >> np.arange(64, dtype=np.uint64)) & _U(1)
    votes = bits.astype(np.int32).sum(axis=1) * 2 - shingles.shape[1]
    return ((votes > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _borders(radius: int) -> np.ndarray:
    return np.linspace(0, 64, radius + 2).astype(np.int64)


def _block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return (prints >> _U(lo)) & _U((1 << (hi - lo)) - 1)


class Items:
    """Benchmark items of one block, indexed by shingle and, for each length, by fingerprint blocks."""

    def __init__(self, rows: list[tuple[int, str]], k: int, radius: int) -> None:
        self.k, self.radius, self.size = k, radius, {}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        shingles = []
        for item, text in rows:
            raw = lower_ascii(np.frombuffer(text.encode(), np.uint8))
            h, _, _ = word_hashes(raw, np.array([0, len(raw)]))
            if len(h):
                s = ngram_hashes(h, min(k, len(h)))
                by_length.setdefault(len(h), []).append((item, s))
                shingles.append((s, len(h)))
        self.lengths = {}
        for n, own in by_length.items():
            prints = fingerprints(np.stack([s for _, s in own]))
            order = [np.argsort(_block(prints, lo, hi), kind="stable") for lo, hi in zip(_borders(radius), _borders(radius)[1:])]
            anchors = np.unique(np.concatenate([s for _, s in own]))
            self.lengths[n] = ([i for i, _ in own], [Counter(s.tolist()) for _, s in own], prints, order, anchors)
        self.anchors = {w: np.unique(np.concatenate([s for s, n in shingles if min(k, n) == w])) for w in {min(k, n) for _, n in shingles}}
        self.longest = max(self.lengths, default=0)
        # for shorter texts: the items that have a shingle, of items with k words or more
        self.long = [(i, len(s), bag) for n, own in by_length.items() if n >= k for (i, s), bag in zip(own, self.lengths[n][1])]
        flat = [s for n, own in by_length.items() if n >= k for _, s in own]
        holder = np.repeat(np.arange(len(flat), dtype=np.int32), [len(s) for s in flat])
        flat = np.concatenate([*flat, np.zeros(0, np.uint64)])
        by = np.argsort(flat, kind="stable")
        self.shingle, self.holder = flat[by], holder[by]

    def _whole(self, h: np.ndarray, num: int, den: int) -> list[tuple[int, int, int, float]]:
        """Matches of a text as a whole with the items that have more words."""
        grams = ngram_hashes(h, self.k)
        m = len(grams)
        least = -(-num * (2 * m + 1) // (num + den))  # shingles that it has in common with an item of m + 1, the smallest
        if not m or least > m:
            return []
        a, b = np.searchsorted(self.shingle, grams, "left"), np.searchsorted(self.shingle, grams, "right")
        if (b > a).sum() < least:
            return []
        # an item without the m - least + 1 rarest has too few of the others
        rare = np.argsort(b - a, kind="stable")[: m - least + 1]
        found = np.unique(np.concatenate([self.holder[a[x] : b[x]] for x in rare.tolist()]))
        bag, out = Counter(grams.tolist()), []
        for item, size, other in map(self.long.__getitem__, found.tolist()):
            if size > m and den * m >= num * size:
                same = sum(min(c, other[s]) for s, c in bag.items() if s in other)
                if same and den * same >= num * (m + size - same):
                    out.append((item, 0, len(h), same / (m + size - same)))
        return out

    def matches(self, h: np.ndarray, num: int, den: int) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the windows of a text with num/den or more; the best window of each run."""
        out = self._whole(h, num, den) if len(h) < self.longest else []
        hits = {}
        for w, known in self.anchors.items():
            grams = ngram_hashes(h, w)
            at = np.searchsorted(known, grams)
            hits[w] = (grams, np.flatnonzero(known[np.minimum(at, len(known) - 1)] == grams))
        for n, (items, bags, prints, order, anchors) in self.lengths.items():
            w = min(self.k, n)
            grams, found = hits[w]
            if not len(found) or len(h) < n:
                continue
            at = np.searchsorted(anchors, grams[found])
            found = found[anchors[np.minimum(at, len(anchors) - 1)] == grams[found]]
            if not len(found):
                continue
            mark = np.zeros(len(h) - n + 2, np.int64)
            np.add.at(mark, np.clip(found - (n - w), 0, len(mark) - 1), 1)
            np.add.at(mark, np.clip(found + 1, 0, len(mark) - 1), -1)
            starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            for lo in range(0, len(starts), 4096):
                out += self._search(grams, starts[lo : lo + 4096], n - w + 1, n, items, bags, prints, order, num, den)
        return out

    def _search(self, grams, starts, m, n, items, bags, prints, order, num, den):
        if not len(starts):
            return []
        windows = grams[starts[:, None] + np.arange(m)]
        own = fingerprints(windows)
        pairs = []
        for (lo, hi), by in zip(zip(_borders(self.radius), _borders(self.radius)[1:]), order):
            key, value = _block(own, lo, hi), _block(prints, lo, hi)[by]
            a, b = np.searchsorted(value, key, "left"), np.searchsorted(value, key, "right")
            window = np.repeat(np.arange(len(own)), b - a)
            item = by[np.arange(len(window)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
            near = np.bitwise_count(own[window] ^ prints[item]) <= self.radius
            pairs.append(window[near] * len(items) + item[near])
        out = []
        for p in np.unique(np.concatenate(pairs)).tolist():
            window, item = divmod(p, len(items))
            bag, other = Counter(windows[window].tolist()), bags[item]
            same = sum(min(c, other[s]) for s, c in bag.items() if s in other)
            if same and den * same >= num * (2 * m - same):
                out.append((items[item], int(starts[window]), n, same / (2 * m - same)))
        return out


def _matched(own: Items, rows, keys: tuple[str, ...], num: int, den: int) -> Iterator[dict]:
    """For each text of rows (a batch or table) and item the best window."""
    for i, j, raw, off in text_slices(rows.column("text")):
        h, _, first = word_hashes(lower_ascii(raw), off)
        marked = {w: own_hits(ngram_hashes(h, w), known) for w, known in own.anchors.items()}
        maybe = np.zeros(j - i, bool)
        for hit in marked.values():
            maybe[np.searchsorted(first, hit, side="right") - 1] = True
        ids = {key: rows.column(key).slice(i, j - i) for key in keys}
        for t in np.flatnonzero(maybe).tolist():
            best: dict[int, tuple] = {}
            for item, start, n, s in own.matches(h[first[t] : first[t + 1]], num, den):
                if item not in best or s > best[item][2]:
                    best[item] = (start, n, s)
            for item, b in best.items():
                yield {**{key: v[t].as_py() for key, v in ids.items()}, "item_id": item, "start_word": b[0], "n_words": b[1], "similarity": b[2]}


def _schema(keys: tuple[str, ...]) -> pa.Schema:
    return pa.schema([*[(key, pa.int64()) for key in keys], ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])


def _find(items, keys: tuple[str, ...], num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if out := list(_matched(items.value, batch, keys, num, den)):
                yield pa.RecordBatch.from_pylist(out, _schema(keys))

    return run


def _shingles(k: int):
    """mapInArrow function: (width, hash) of the shingles of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, off in text_slices(batch.column("text")):
                h, _, first = word_hashes(lower_ascii(raw), off)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    if b > a:
                        s = ngram_hashes(h[a:b], min(k, b - a))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), min(k, b - a))), pa.array(s.view(np.int64))], ["width", "h"])

    return run


def _sharing(bits, widths: list[int]):
    """mapInArrow function: the rows whose text may have a shingle in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = np.zeros(batch.num_rows, bool)
            for i, _, raw, off in text_slices(batch.column("text")):
                h, _, first = word_hashes(lower_ascii(raw), off)
                for w in widths:
                    hit = np.flatnonzero(in_bitmap(bits.value, ngram_hashes(h, w)))
                    maybe[i + np.searchsorted(first, hit, side="right") - 1] = True
            if maybe.any():
                yield batch.filter(pa.array(maybe))

    return run


def _by_blocks(docs: DataFrame, items: DataFrame, blocks: int, k: int, num: int, den: int, radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """leaks() by blocks of items: parts of the documents that share a shingle with the benchmark meet each block in a task."""
    shingles = items.mapInArrow(_shingles(k), "width long, h long")
    widths = [r.width for r in shingles.select("width").distinct().collect()]
    near = docs.mapInArrow(_sharing(bitmap(shingles, F.col("h"), 26), widths), docs.schema)
    near = table(near.withColumn("row", F.monotonically_increasing_id()))
    chars = near.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    parts = 1 + chars // PART_CHARS
    left = near.select("row", "text", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = items.distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))

    def search(texts: pa.Table, block: pa.Table) -> pa.Table:
        own = Items(list(zip(block.column("item_id").to_pylist(), block.column("text").to_pylist())) if texts.num_rows else [], k, radius)
        return pa.Table.from_pylist(list(_matched(own, texts, ("row",), num, den)), _schema(("row",)))

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, "row long, item_id long, start_word long, n_words long, similarity double")
    # an item_id whose texts are in several blocks
    best = found.groupBy("row", "item_id").agg(F.max_by(F.struct("start_word", "n_words", "similarity"), "similarity").alias("b"))
    return near.select("row", "doc_id", *keys).join(best, "row").select("doc_id", *keys, "item_id", "b.*")


def own_hits(grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places whose hash is known; a table of 2**16 low bits keeps most of them from the search."""
    low = np.zeros(1 << 16, bool)
    low[(known & _U(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(low[(grams & _U(0xFFFF)).astype(np.int64)])
    where = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
    return at[known[where] == grams[at]]


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100, radius: int = 24, block_words: int = 2_000_000, keys: tuple[str, ...] = ()) -> DataFrame:
    """Leaks: doc_id, item_id, and the best window's start_word, n_words, similarity; one row per document and item.

    An item with fewer than k words is one shingle; an empty or null item or
    text has none. A text with fewer words than an item is compared with it as
    a whole. Null doc_ids are reported as null. keys names bigint columns of
    docs that are carried, after doc_id.
    """
    items = benchmark.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = documents(docs, *keys)
    words = items.agg(F.sum(F.size(F.split("text", "[ \t-\r]+")) + 1)).first()[0] or 0
    if words > block_words:
        return _by_blocks(docs, items, -(-words // block_words), k, num, den, radius, keys)
    shared = docs.sparkSession.sparkContext.broadcast(Items([(r.item_id, r.text) for r in items.collect()], k, radius))
    return docs.mapInArrow(_find(shared, ("doc_id", *keys), num, den), "doc_id long, " + "".join(f"{c} long, " for c in keys) + "item_id long, start_word long, n_words long, similarity double")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

"""Substring dedup: word spans that occur earlier in the corpus are removed (suffix automata).

Every window of `window` words has one anchor: its smallest hashed gram of
`gram` words. Equal windows have equal anchors, so anchors split the corpus
into reference shards that can be matched on their own. An anchor occurrence
with the words of all its windows is a context.

1. anchors that occur once are left out through a bitmap of fixed size;
2. occurrences are grouped by context; all but the first of a context go whole;
3. anchors with several contexts: the first occurrence of each context is
   streamed, in corpus order, through the suffix automaton of the contexts
   before it. Matching statistics of `window` words or more mark spans to remove.

The automata are built where the shards lie and not broadcast: the reference
grows with the corpus, so sending every automaton to every task would not be
bounded. Anchors with many contexts are split further by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, documents, in_bitmap, read, table
from .words import mix, ngram_hashes, text_slices, word_hashes

_U = np.uint64
_OCC = "anchor long, context long, doc_id long, start long, n int"


def occurrences(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor occurrences of the texts whose word hashes are h[first[k]:first[k+1]].

    Returns anchor hash, text number, first window start within the text, and
    number of windows. Consecutive windows with the same anchor place make one.
    """
    n_words = np.diff(first)
    total = len(h)
    if total < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = ngram_hashes(h, gram)
    span = window - gram + 1
    # smallest gram of each window by doubling; ties go to the leftmost place
    best, at, width = grams, np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[:-step], best[step:]
        right = b < a
        best, at = np.where(right, b, a), np.where(right, at[step:], at[:-step])
        width += step
    starts = np.arange(len(best))
    text = np.repeat(np.arange(len(n_words)), n_words)[: len(best)]
    good = starts + window <= first[1:][text]
    starts, at, text, best = starts[good], at[good], text[good], best[good]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    return best[heads], text[heads], starts[heads] - first[:-1][text[heads]], np.diff(np.append(heads, len(starts)))


def _context_hashes(h: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of h[begin:begin+length] for each pair: a polynomial from prefix sums of h * P**i."""
    up = np.empty(len(h) + 1, np.uint64)
    up[0] = 1
    up[1:] = _U(0xD1342543DE82EF95)
    up = np.multiply.accumulate(up)
    down = np.empty(len(h) + 1, np.uint64)
    down[0] = 1
    down[1:] = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))
    down = np.multiply.accumulate(down)
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=prefix[1:])
    return mix((prefix[begin + length] - prefix[begin]) * down[begin] + length.astype(np.uint64))


def _scan(window: int, gram: int, flagged=None, chosen=None, words: bool = False):
    """mapInArrow function: the anchor occurrences of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            for i, _, raw, off in text_slices(batch.column("text")):
                h, _, first = word_hashes(raw, off)
                a, text, start, n = occurrences(h, first, window, gram)
                if flagged is not None and len(a):
                    keep = in_bitmap(flagged.value, a)
                    a, text, start, n = a[keep], text[keep], start[keep], n[keep]
                if not len(a):
                    continue
                if flagged is None:
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64))], ["anchor"])
                    continue
                doc, begin = ids[i + text], first[:-1][text] + start
                if chosen is not None:
                    keep = in_bitmap(chosen.value, _place_hash(a, doc, start))
                    a, doc, start, n, begin = a[keep], doc[keep], start[keep], n[keep], begin[keep]
                c = _context_hashes(h, begin, n + window - 1)
                columns = [pa.array(x.view(np.int64)) for x in (a, c)] + [pa.array(doc), pa.array(start), pa.array(n.astype(np.int32))]
                names = ["anchor", "context", "doc_id", "start", "n"]
                if words:
                    columns.append(pa.array([h[b : b + k + window - 1].tobytes() for b, k in zip(begin.tolist(), n.tolist())], pa.binary()))
                    names.append("words")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _place_hash(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """As PLACE in Spark."""
    return anchor ^ (doc.view(np.uint64) << _U(9)) ^ start.view(np.uint64)


PLACE = "anchor ^ shiftleft(doc_id, 9) ^ start"


class SuffixAutomaton:
    """Suffix automaton of several word sequences; tells the longest suffix that occurs in it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, q, w)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = cur

    def _clone(self, p: int, q: int, w: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def matching(self, words: list[int]) -> list[int]:
        """Length of the longest suffix of words[:i + 1] that occurs in the automaton, for each i."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state, size = nxt[state][w], size + 1
            out.append(size)
        return out


def _stream(window: int):
    """mapInArrow function over contexts sorted by shard and place: spans that occur before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, SuffixAutomaton()
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            keys = zip(batch.column("anchor").to_pylist(), batch.column("part").to_pylist())
            for key, doc, start, blob in zip(keys, batch.column("doc_id").to_pylist(), batch.column("start").to_pylist(), batch.column("words").to_pylist()):
                if key != shard:
                    shard, automaton = key, SuffixAutomaton()
                words = np.frombuffer(blob, np.uint64).tolist()
                found = [i - window + 1 for i, m in enumerate(automaton.matching(words)) if m >= window]
                out += [(doc, start + i, 1) for i in found]
                if len(found) <= len(words) - window:
                    automaton.add(words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "start", "n"])

    return run


def repeated_spans(docs: DataFrame, window: int = 20, gram: int = 8, log2_bits: int = 26, shard_contexts: int = 20_000) -> DataFrame:
    """Windows that start earlier elsewhere: rows (doc_id, start, n), n window starts from word `start` on.

    "Earlier" is a smaller doc_id, or the same doc_id and an earlier start.
    Rows with a null doc_id are not compared. Documents that share a doc_id
    but not the text are compared as if each were the other's repeat.
    """
    docs = documents(docs).where("doc_id is not null").select("doc_id", "text")
    anchors = docs.mapInArrow(_scan(window, gram), "anchor long")
    flagged = bitmap(anchors.groupBy("anchor").count().where("count > 1"), F.col("anchor"), log2_bits)
    occ = table(docs.mapInArrow(_scan(window, gram, flagged), _OCC))
    contexts = occ.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times"), F.max("n").alias("n"))
    contexts = table(contexts.select("anchor", "context", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "times", "n"))
    firsts = contexts.where("times > 1").select("anchor", "context", F.col("doc_id").alias("d0"), F.col("start").alias("s0"))
    later = occ.join(firsts, ["anchor", "context"]).where("doc_id <> d0 or start <> s0").select("doc_id", "start", "n")
    several = contexts.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
    several = table(contexts.join(several, "anchor").select("anchor", "doc_id", "start", "k"))
    chosen = bitmap(several, F.expr(PLACE), log2_bits)
    shards = several.groupBy("anchor").agg(F.max("k").alias("k"))
    streamed = docs.mapInArrow(_scan(window, gram, flagged, chosen, words=True), _OCC + ", words binary")
    streamed = streamed.join(shards, "anchor")
    # an anchor with many contexts is dealt out by window: each part sees every context with a window of its own
    parts = F.greatest(F.lit(1), F.ceil(F.col("k") / shard_contexts).cast("int"))
    streamed = streamed.withColumn("parts", parts)
    whole = streamed.where("parts = 1").select("anchor", F.lit(0).alias("part"), "doc_id", "start", "words")
    cut = streamed.where("parts > 1").select("anchor", "doc_id", "start", "words", "parts", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i", "_i"))
    piece = F.expr(f"substring(words, 1 + 8 * i, {8 * window})")
    cut = cut.select("anchor", F.pmod(F.xxhash64(piece), "parts").cast("int").alias("part"), "doc_id", (F.col("start") + F.col("i")).alias("start"), piece.alias("words"))
    ordered = whole.unionByName(cut).repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc_id", "start")
    return later.unionByName(ordered.mapInArrow(_stream(window), "doc_id long, start long, n int"))


def _cut(window: int):
    """mapInArrow function: documents with their spans; drops the covered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids, spans = batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist()
            texts = batch.column("text").to_pylist()
            for doc, text, found in zip(ids, texts, spans):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                space = (raw == 32) | ((raw >= 9) & (raw <= 13))
                edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
                begin, end = edge[::2], edge[1::2]
                n = len(begin)
                data = raw.tobytes()
                if found:
                    mark = np.zeros(n + 1, np.int64)
                    s = np.array([x["start"] for x in found])
                    np.add.at(mark, s, 1)
                    np.add.at(mark, s + np.array([x["n"] for x in found]) + window - 1, -1)
                    keep = np.flatnonzero(np.cumsum(mark)[:-1] <= 0)
                else:
                    keep = np.arange(n)
                kept = b" ".join([data[b:e] for b, e in zip(begin[keep].tolist(), end[keep].tolist())])
                for column, value in zip(out, (doc, n, n - len(keep), kept.decode())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return run


def substring_dedup(docs: DataFrame, window: int = 20, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, text (kept words joined by one space).

    Null texts count as empty; a null doc_id leaves the text as it is, with
    nothing removed. Other columns of docs are ignored.
    """
    spans = repeated_spans(docs, window, **options)
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = documents(docs).join(per_doc, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, text string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))

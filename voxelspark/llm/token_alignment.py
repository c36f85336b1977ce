"""Cross-tokenizer alignment: groups of tokens that end together, and counts of the id pairs they link.

Texts are cut before spaces where neither tokenizer joins what is parted; each
distinct piece is encoded by both once. The pairs of a slice of documents are
written as sorted runs: for each radix (A id modulo RADIX) the distinct pairs,
A id first, each with the documents that hold it, compressed with zstd. That
table is the spill. Counting reads the heads of the runs only (pairs and their
number of documents): runs of a radix wait in a heap by size and the smallest
are merged, FAN at a time; the merged order is by A id, so one pass over it
gives each A id's highest count. Then the runs stream past those counts, and
what each link adds to its document is summed per task and sent back. A task of
that step takes the runs of some slices (their salt) and of a SIDES-th of the
radixes, so a document gets SIDES sums, however many tasks there are. A slice
meets the counts in its own row, so no id and no document gathers rows: a
frequent id is a longer stretch of many runs.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, read, table
from .pieces import Pool, distinct, gather
from .words import text_slices

RADIX, FAN, RUNS, SIDES = 256, 64, 32_768, 8
_SLICE, _ROWS, _KNOWN, _SUMS, _JOIN, _PIECES = 1 << 22, 1 << 15, 1 << 18, 1 << 22, 1024, 1 << 22
_models: dict[tuple[str, str], "Aligner"] = {}
_SPILL = "run long, local int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, docs int, heads binary, tails binary"


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


def align(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the groups (common ends), the group of each A and B token, and the links A << 16 | B in order of A tokens.

    Ends are strictly ascending byte offsets with the same last value.
    """
    ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
    of_a, of_b = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
    first_b, n_b = np.searchsorted(of_b, np.arange(len(ends))), np.bincount(of_b, minlength=len(ends))
    links = np.repeat(a.astype(np.uint32) << np.uint32(16), n_b[of_a]) | gather(b.astype(np.uint32), first_b[of_a], n_b[of_a])
    return ends, of_a, of_b, links


def spaces(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Single spaces that both tokenizers put at the start of a token in any case: behind what is surely not white space, before another byte of the text that is not a space."""
    out = np.zeros(len(raw), bool)
    if len(raw) > 2:
        before, here, after = raw[:-2], raw[1:-1], raw[2:]
        second = np.concatenate([[0], raw[:-3]]).astype(np.uint8)
        maybe = (second == 0x80) | (second == 0x81) | (second == 0x9A) | ((second == 0xC2) & ((before == 0x85) | (before == 0xA0)))
        out[1:-1] = (here == 32) & (after != 32) & (((before > 32) & (before < 128)) | ((before >= 128) & ~maybe))
    edges = off[off < len(raw)]
    out[edges] = False  # first byte of a text
    out[off[off > 0] - 1] = False  # last byte of a text
    return out


def digests(text: list[str | None], numbers: np.ndarray, first: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups; '' without any. A longer text than Arrow joins in one array is hashed in parts."""
    out = []
    own = pa.array(text, pa.string())
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()) if first[-1] - first[0] > _PIECES else []:
        h = hashlib.sha256()
        for k in range(a, b, _PIECES):
            h.update((";" * (k > a) + ";".join(x or "" for x in own.take(pa.array(numbers[k : min(b, k + _PIECES)])).to_pylist())).encode())
        out.append(h.hexdigest() if a < b else "")
    if not out:
        lists = pa.ListArray.from_arrays(pa.array(first - first[0], pa.int32()), own.take(pa.array(numbers[first[0] : first[-1]])))
        joined = pc.binary_join(lists, ";")
        out = [hashlib.sha256(joined[k].as_buffer()).hexdigest() if a < b and joined[k].is_valid else "" for k, (a, b) in enumerate(zip(first[:-1], first[1:]))]
    return out


class Aligner:
    """Both tokenizers, their tokens' bytes, and the pieces met lately."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        if max(n_a, n_b) > 1 << 16:
            raise ValueError("pairs of ids have 16 bits each")
        alphabet = byte_alphabet()
        self.a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in map(self.a.id_to_token, range(n_a))]
        self.a_length = np.array([len(t) for t in self.a_bytes])
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_length = np.array([len(t) for t in self.b_bytes])
        #: whether no piece goes on past a space
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.names = [str(i) for i in range(max(n_a, n_b))]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text: list[str | None] = []
        self.links, self.first, self.sizes = Pool(np.uint32), Pool(np.int64), [Pool(np.int64) for _ in range(4)]

    def both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of space + text by A, of text by B, and whether both joined are space + text."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        whole = [b" " + t.encode() for t in texts]
        same = [bool(t) and b"".join(map(self.b_bytes.__getitem__, y)) == w and b"".join(map(self.a_bytes.__getitem__, x)) == w for t, w, x, y in zip(texts, whole, a, b)]
        return a, b, np.array(same, bool)

    def describe(self, texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Of each text: its groups as a string (None where the bytes differ), n_a, n_b, n_groups, n_links (rows), and all links."""
        a, b, same = self.both(texts)
        size = np.zeros((4, len(texts)), np.int64)
        out: list[str | None] = [None] * len(texts)
        fit = np.flatnonzero(same)
        if not len(fit):
            return out, size, np.zeros(0, np.uint32)
        size[0, fit], size[1, fit] = [len(a[k]) for k in fit], [len(b[k]) for k in fit]
        a_ids, b_ids = (np.fromiter((i for k in fit for i in x[k]), np.int64) for x in (a, b))
        a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        ends, of_a, of_b, links = align(a_ids, b_ids, a_ends, b_ends)
        n_a, n_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        last_a = np.cumsum(size[0, fit])
        group_end = of_a[last_a - 1] + 1
        size[2, fit] = np.diff(group_end, prepend=0)
        per_group = np.concatenate([[0], np.cumsum(n_a * n_b)])
        size[3, fit] = np.diff(per_group[group_end], prepend=0)
        cut_a, cut_b = (np.concatenate([[0], np.cumsum(n)]).tolist() for n in (n_a, n_b))
        names_a, names_b = [self.names[i] for i in a_ids], [self.names[i] for i in b_ids]
        groups = [",".join(names_a[i:j]) + "|" + ",".join(names_b[k:m]) for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        for k, lo, hi in zip(fit.tolist(), [0, *group_end.tolist()], group_end.tolist()):
            out[k] = ";".join(groups[lo:hi])
        return out, size, links

    def entries(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of pieces in the pools."""
        if len(self.known) > _KNOWN:
            self.forget()
        new = [w for w in pieces if w not in self.known]
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            text, size, links = self.describe([w.decode() for w in some])
            self.known.update(zip(some, range(len(self.text), len(self.text) + len(some))))
            self.text += text
            self.first.add(self.links.add(links) + np.cumsum(size[3]) - size[3])
            for pool, s in zip(self.sizes, size):
                pool.add(s)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def slice(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links of each text (rows), digests, and each link with its text's number."""
        cut = spaces(raw, off) if self.parts else np.zeros(len(raw), bool)
        pieces, numbers, first = distinct(raw, off, cut)
        n = len(off) - 1
        entry = self.entries(pieces)
        text = [self.text[e] for e in entry]
        odd = np.array([t is None for t in text], bool)
        of = np.repeat(np.arange(n), np.diff(first))
        bad = np.zeros(n, bool)
        if odd.any():
            bad[of[odd[numbers]]] = True
        good = ~bad[of]
        entry = entry[numbers] if len(pieces) else numbers
        size = np.stack([np.bincount(of[good], pool.items[entry[good]], n).astype(np.int64) for pool in self.sizes])
        long = self.sizes[3].items[entry[good]]
        links, where = gather(self.links.items, self.first.items[entry[good]], long), np.repeat(of[good], long)
        sha = [""] * n
        for lo in range(0, n if len(pieces) else 0, _JOIN):
            hi = min(n, lo + _JOIN)
            for k, h in zip(range(lo, hi), digests(text, numbers, first[lo : hi + 1])):
                sha[k] = "" if bad[k] else h
        for k in np.flatnonzero(bad):  # texts that a tokenizer changes, or whose pieces do not tell: as one piece
            own, own_size, own_links = self.describe([raw[off[k] : off[k + 1]].tobytes().decode()])
            if own[0] is not None:
                size[:, k], sha[k] = own_size[:, 0], hashlib.sha256(own[0].encode()).hexdigest()
                links, where = np.concatenate([links, own_links]), np.concatenate([where, np.full(len(own_links), k)])
        return size, sha, links, where


def _aligner(models: tuple[str, str]) -> Aligner:
    if models not in _models:
        _models[models] = Aligner(*models)
    return _models[models]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers as one zstd frame."""
    return zstandard.compress(np.concatenate([[len(a) for a in arrays], *arrays]).astype("<u4").tobytes(), 1)


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.decompress(data), "<u4")
    return np.split(flat[n:], np.cumsum(flat[:n].astype(np.int64))[:-1])


def runs(links: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted runs of a slice: radix, heads (steps between pairs, documents of each), tails (documents, links in each)."""
    order = np.sort(((links >> np.uint32(16)) % RADIX).astype(np.uint64) << np.uint64(48) | links.astype(np.uint64) << np.uint64(16) | where.astype(np.uint64))
    at = np.flatnonzero(np.diff(order, prepend=~order[:1]))
    times, held = np.diff(at, append=len(order)), order[at]
    radix, pair, doc = held >> np.uint64(48), (held >> np.uint64(16)).astype(np.uint32), (held & np.uint64(0xFFFF)).astype(np.uint32)
    cuts = np.searchsorted(radix, np.arange(RADIX + 1).astype(np.uint64))
    for r in np.flatnonzero(np.diff(cuts)):
        p = pair[cuts[r] : cuts[r + 1]]
        starts = np.flatnonzero(np.diff(p, prepend=~p[:1]))
        yield int(r), _pack(np.diff(p[starts], prepend=np.uint32(0)), np.diff(starts, append=len(p))), _pack(doc[cuts[r] : cuts[r + 1]], times[cuts[r] : cuts[r + 1]])


def _spill(models: tuple[str, str]):
    names = [f.split()[0] for f in _SPILL.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in _SPILL.split(", ")]

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(models)
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                ids = part.column("doc_id")
                for i, j, raw, off in text_slices(part.column("text"), _SLICE):
                    size, sha, links, where = aligner.slice(raw, off)
                    mark, n = uuid.uuid4().int >> 65, j - i
                    yield rows(n, run=[mark] * n, local=np.arange(n), doc_id=ids.slice(i, n), **dict(zip(("n_a", "n_b", "n_groups", "n_links"), size)), groups_sha256=sha)
                    found = list(runs(links, where)) if len(links) else []
                    for k in range(0, len(found), 64):
                        some = found[k : k + 64]
                        yield rows(len(some), run=[mark] * len(some), radix=[x[0] for x in some], docs=[n] * len(some), heads=[x[1] for x in some], tails=[x[2] for x in some])

    return run


def merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal pairs of sorted runs: the FAN smallest runs of a heap are merged at a time."""
    heap = [(len(p), k, p, n) for k, (p, n) in enumerate(held)]
    heapq.heapify(heap)
    mark = len(heap)
    while len(heap) > 1:
        some = [heapq.heappop(heap) for _ in range(min(FAN, len(heap)))]
        pair, n = np.concatenate([x[2] for x in some]), np.concatenate([x[3] for x in some])
        by = np.argsort(pair, kind="stable")
        pair, n = pair[by], n[by]
        at = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
        heapq.heappush(heap, (len(at), mark, pair[at], np.add.reduceat(n, at)))
        mark += 1
    return heap[0][2], heap[0][3]


def _grouped(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch, int]]:
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in key)))
        for i, k in enumerate(keys):
            yield k, batch, i


def _count(merged: bool):
    """Sum the heads of each radix and salt; merged: heads are pairs with 64-bit counts already."""

    def load(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        pair, *n = _unpack(data, 3 if merged else 2)
        return np.cumsum(pair, dtype=np.uint32), n[0].astype(np.int64) + (n[1].astype(np.int64) << 32 if merged else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, total = None, [], 0

        def result() -> pa.RecordBatch:
            pair, n = merge(held)
            data = _pack(np.diff(pair, prepend=np.uint32(0)), n & 0xFFFFFFFF, n >> 32)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([data], pa.binary())], ["radix", "heads"])

        for key, batch, i in _grouped(batches, ("radix", "salt")):
            if key != now:
                if held:
                    yield result()
                now, held, total = key, [], 0
            held.append(load(batch.column("heads")[i].as_py()))
            total += len(held[-1][0])
            if total > _SUMS and len(held) > 1:
                held = [merge(held)]
                total = len(held[0][0])
        if held:
            yield result()

    return run


def _send_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream the runs of a radix past its counts; per document of a run: links with their A id's highest count, and the sum of counts."""
    now, pairs, counts, highest = None, None, None, None
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held = 0

    def result() -> Iterator[pa.RecordBatch]:
        for mark, (best, total) in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), mark)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], ["run", "local", "n_best", "count_sum"])

    for key, batch, i in _grouped(batches, ("radix", "salt")):
        if key != now:
            step, low, high = _unpack(batch.column("heads")[i].as_py(), 3)
            now, pairs, counts = key, np.cumsum(step, dtype=np.uint32), low.astype(np.int64) + (high.astype(np.int64) << 32)
            heads = np.flatnonzero(np.diff(pairs >> np.uint32(16), prepend=~(pairs[:1] >> np.uint32(16))))
            highest = counts == np.repeat(np.maximum.reduceat(counts, heads), np.diff(heads, append=len(pairs)))
            continue
        step, n = _unpack(batch.column("heads")[i].as_py(), 2)
        doc, times = _unpack(batch.column("tails")[i].as_py(), 2)
        at = np.repeat(np.searchsorted(pairs, np.cumsum(step, dtype=np.uint32)), n)
        mark, docs = batch.column("run")[i].as_py(), batch.column("docs")[i].as_py()
        if mark not in sums:
            if held + docs > _SUMS:
                yield from result()
                sums.clear()
                held = 0
            sums[mark] = (np.zeros(docs, np.int64), np.zeros(docs, np.int64))
            held += docs
        best, total = sums[mark]
        np.add.at(best, doc, times * highest[at])
        np.add.at(total, doc, times * counts[at])
    yield from result()


def alignment(docs: DataFrame, models: tuple[str, str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    A null or empty text, and one whose tokens do not join to space + text by
    either tokenizer, has no tokens: zeros and ''. Every row is a document of
    its own, rows of one doc_id and null doc_ids too. A text of any length is
    taken whole. Other columns are not used. An empty table gives no rows.
    Ties for the highest count all count. Needs vocabularies of at most 65,536
    ids each.
    """
    spark = docs.sparkSession
    spill = table(documents(docs).mapInArrow(_spill(models or default_models()), _SPILL))
    held = spill.where("radix is not null").select("run", "radix", "docs", "heads", "tails")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(math.ceil(tasks / SIDES), math.ceil(held.where("radix = 0").count() / RUNS))
    salt = F.pmod("run", F.lit(salts)).cast("int")

    def dealt(df: DataFrame, n: int) -> DataFrame:
        """Rows of one radix and salt together; radixes are dealt out evenly."""
        return df.repartitionById(tasks, F.pmod(F.col("radix") * n + F.col("salt"), F.lit(tasks)))

    heads = "radix int, heads binary"
    counts = dealt(held.select("radix", salt.alias("salt"), "heads"), salts).sortWithinPartitions("radix", "salt").mapInArrow(_count(False), heads)
    counts = dealt(counts.withColumn("salt", F.lit(0)), 1).sortWithinPartitions("radix", "salt").mapInArrow(_count(True), heads)
    first = counts.select("radix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("run"), F.lit(0).alias("docs"), "heads", F.lit(None).cast("binary").alias("tails"))
    stream = first.unionByName(held.withColumn("salt", salt))
    stream = stream.repartitionById(tasks, F.pmod(F.col("salt") * SIDES + F.pmod("radix", F.lit(SIDES)), F.lit(tasks)))
    stream = stream.sortWithinPartitions("salt", "radix", F.col("run").isNotNull())
    sums = stream.mapInArrow(_send_back, "run long, local int, n_best long, count_sum long").groupBy("run", "local").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = spill.where("local is not null").select("run", "local", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return rows.join(sums, ["run", "local"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *zero)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read(spark, sf_dir, "documents"))

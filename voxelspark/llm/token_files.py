"""Token-ID output: flat unsigned integer files and 64-bit document offsets, read by memory map.

Documents are range-partitioned and sorted by doc_id, so a partition is a
stretch of the token stream. Its task encodes them and writes three flat files
without headers, little-endian: `.ids` (16 bits an id, 32 where the vocabulary
needs it), `.off` (64 bits: where each document starts in that file, and its
end) and `.doc` (64 bits: doc_id). The manifest gives each partition the
number of documents and ids before it, which are prefix sums of the counts that
the tasks return. File names hold an attempt's own mark and only what the
manifest names is part of the output, so a task that is run again or twice does
no harm.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, read, shared_folder
from .pieces import Pool, distinct, gather, white
from .words import lower_ascii, text_slices

END, NULL_ID = 2, -(1 << 63)
_MANIFEST = "part int, name string, width int, docs long, ids long, first_doc long, first_id long"
_PARTS = "part int, name string, width int, docs long, ids long"
_KNOWN = 3 << 18
_SLICE = 1 << 22
_encoders: dict[str, "Encoder"] = {}

#: Classes of bytes: 1 letter, 2 digit, 3 other ASCII, 0 white space or part of a character that is not ASCII.
_CLASS = np.array([0 if b > 127 or b == 32 or 9 <= b <= 13 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


def cuts(raw: np.ndarray, dropped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before which the tokenizer cuts in any case, and the text with small ASCII letters.

    Letters, digits and signs part from each other and digits from digits; an
    apostrophe may take the letters behind it along. Words (between white
    space) with the start of a control string stay as they are.
    """
    kind = _CLASS[raw]
    cut = np.zeros(len(raw), bool)
    cut[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~((raw[:-1] == 39) & (kind[1:] == 1))
    small, hi = lower_ascii(raw), 0
    for at in np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)):
        if at < hi:
            continue
        lo, hi = at, at + 1
        while lo and not dropped[lo - 1]:
            lo -= 1
        while hi < len(raw) and not dropped[hi]:
            hi += 1
        cut[lo:hi], small[lo:hi] = False, raw[lo:hi]
    return cut, small


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts by a tokenizer that drops white space and never joins what cuts() parts.

    Pieces are encoded by the tokenizer once and kept, at
    most _KNOWN of them besides those of one slice.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.lengths = Pool(self.kind), Pool(np.int64), Pool(np.int64)
        self._add([[END]])

    def _add(self, ids: list[list[int]]) -> None:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        at = self.ids.add(np.fromiter((i for x in ids for i in x), self.kind, int(n.sum())))
        self.starts.add(at + np.cumsum(n) - n)
        self.lengths.add(n)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with END behind each, and where each text's start (with an end mark)."""
        between = white(raw)
        cut, small = cuts(raw, between)
        words, numbers, first = distinct(small, off, between, cut)
        if len(self.known) > _KNOWN:
            self.forget()
        new = [w for w in words if w not in self.known]
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            self._add([e.ids for e in self.model.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)])
            self.known.update(zip(some, range(len(self.known) + 1, len(self.known) + 1 + len(some))))
        entry = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        entries = np.insert(entry[numbers] if len(words) else numbers, first[1:], 0)  # entry 0 is END
        lengths = self.lengths.items[entries]
        ids = gather(self.ids.items, self.starts.items[entries], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[first + np.arange(len(first))]


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _write(root: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(model), TaskContext.get().partitionId()
        name, out = f"part-{part:08d}-{uuid.uuid4().hex}", {}
        docs = ids = 0
        for batch in batches:
            doc_ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
            for i, j, raw, off in text_slices(batch.column("text"), _SLICE):
                if not out:
                    store, folder = _place(root)
                    out = {k: store.open_output_stream(f"{folder}/{name}.{k}", compression=None) for k in ("ids", "off", "doc")}
                found, at = encoder.encode(raw, off)
                out["ids"].write(found.astype(found.dtype.newbyteorder("<")).tobytes())
                out["off"].write((ids + at[:-1]).astype("<i8").tobytes())
                out["doc"].write(doc_ids[i:j].astype("<i8").tobytes())
                docs, ids = docs + j - i, ids + len(found)
        if out:
            out["off"].write(np.array([ids], "<i8").tobytes())
            for f in out.values():
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([encoder.ids.items.itemsize], pa.int32()), pa.array([docs], pa.int64()), pa.array([ids], pa.int64())], ["part", "name", "width", "docs", "ids"])

    return run


def write_tokens(docs: DataFrame, root: str, model: str | None = None, parts: int | None = None) -> DataFrame:
    """Write the ids of all texts below root, a new folder that all executors reach, and return the manifest.

    Documents stand in ascending order of doc_id, null doc_ids first (as
    NULL_ID in the files); rows of one doc_id are ordered by a hash of their
    text, and equal rows stand in any order. They may be split over
    partitions, so docs must be read from a table. A null text is empty: its
    only id is END. Other columns of docs are not used. An empty table gives
    an empty manifest. Memory follows the slices of a text batch, or the
    longest text. The manifest has a row for each partition; only these reach
    the driver.
    """
    spark, model = docs.sparkSession, model or default_model()
    store, folder = _place(root)
    store.create_dir(folder, recursive=True)
    keyed = documents(docs)
    tie, copy = fresh(keyed, "tie", "copy")
    keyed = keyed.withColumns({tie: F.xxhash64("text"), copy: F.monotonically_increasing_id()})
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "doc_id", tie, copy).sortWithinPartitions("doc_id", tie, copy).select("doc_id", "text")
    rows = sorted(map(tuple, ordered.mapInArrow(_write(root, model), _PARTS).collect()))
    n_docs, n_ids = (np.cumsum([0, *(r[k] for r in rows)]).tolist() for k in (3, 4))
    rows = [(*r, d, i) for r, d, i in zip(rows, n_docs, n_ids)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{root}/manifest")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Partitions of the token stream: their files and the documents and ids before them."""
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def mapped(root: str, name: str, kind: str, width: int = 8) -> np.ndarray:
    """A flat file as an array: a memory map where it has a path, else its bytes."""
    store, path = _place(f"{root}/{name}.{kind}")
    form = np.dtype(f"<u{width}" if kind == "ids" else "<i8")
    if isinstance(store, pa.fs.LocalFileSystem):
        return np.memmap(path, form, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), form)


def _parts(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """ids, offsets, doc_ids and the ids before them of each partition."""
    for batch in batches:
        for r in batch.to_pylist():
            ids, off, doc = (mapped(root, r["name"], k, r["width"]) for k in ("ids", "off", "doc"))
            if len(doc) != r["docs"] or len(off) != r["docs"] + 1 or len(ids) != r["ids"] or off[-1] != r["ids"]:
                raise ValueError(f"{r['name']} does not have what the manifest says")
            yield ids, off, doc, r["first_id"]


def _row(doc: np.ndarray) -> pa.Array:
    return pa.array(doc, pa.int64(), mask=doc == NULL_ID)


def _read(root: str, step: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, off, doc, first in _parts(root, batches):
            i = 0
            while i < len(doc):
                j = min(len(doc), max(i + 1, int(np.searchsorted(off, off[i] + step, "right")) - 1))
                flat = pa.array(ids[off[i] : off[j]].astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array((off[i : j + 1] - off[i]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([_row(doc[i:j]), pa.array(first + off[i:j]), lists], ["doc_id", "start", "ids"])
                i = j

    return run


def _digest(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, off, doc, first in _parts(root, batches):
            for i in range(0, len(doc), 4096):
                j = min(len(doc), i + 4096)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[i:j], off[i + 1 : j + 1])]
                yield pa.RecordBatch.from_arrays([_row(doc[i:j]), pa.array(first + off[i:j]), pa.array(np.diff(off[i : j + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _dealt(spark: SparkSession, root: str) -> DataFrame:
    rows = manifest(spark, root)
    return rows.repartition(max(1, rows.count()))


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), ids."""
    return _dealt(spark, root).mapInArrow(_read(root), "doc_id long, start long, ids array<int>")


def token_digests(spark: SparkSession, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
    return _dealt(spark, root).mapInArrow(_digest(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark)
    write_tokens(read(spark, sf_dir, "documents"), root)
    return token_digests(spark, root)

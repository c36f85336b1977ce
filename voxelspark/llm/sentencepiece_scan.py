"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding is a best path over (last piece, position) states: a step to the next
piece adds its weight, and weights are combined by max and plus. A unigram
model has its piece scores as weights. A BPE model has weight 0 where two
neighbouring pieces stay apart when their joined text is merged alone, and
minus infinity where they don't; a piece sequence is the model's encoding
exactly if all its neighbours stay apart, so the best path is its encoding.

Texts over `chunk` characters are cut into chunks. For each, a transfer matrix
gives the best weight from every state that may cross its left border to every
state that may cross its right border. The matrices of a text are combined
associatively in a tree; the prefix and suffix products fix the states at all
borders, and each chunk is traced back on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, read, table
from .pieces import distinct, gather
from .words import text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_NO = -np.inf
_SLICE = 1 << 21  # bytes of the texts whose distinct words are looked up together
_MEMO = 200_000  # words of 64 characters at most: about 40 MB for each of two generations
_PAIRS = 400_000  # pairs of pieces, likewise
_HEADS = 30_000
_HEAD = 7  # words share the work on so many first characters


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces of a SentencePiece model: unigram or BPE, identity normalisation, byte fallback or one unknown id."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, dummy_prefix: bool = True) -> None:
        # kinds: 1 normal, 2 unknown, 3 control, 6 byte
        self.bpe, self.dummy_prefix = bpe, dummy_prefix
        self.pieces = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4)}
        self.score = [s for _, s, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unk = next((i for i, k in enumerate(self.kind) if k == 2), 0)
        self.longest = max(map(len, self.ids), default=1)
        known = {c for p in self.ids if len(p) > 1 for c in p}
        self.inside = {c for p in self.ids for c in p[1:]}
        self.heads = not any(SPACE in p.lstrip(SPACE) for p in self.ids)  # no piece goes on past a later space mark
        self.known = known
        self.floor = min((s for p, s, k in pieces if k == 1), default=0.0) - 10
        self.value = {p: self.score[i] for p, i in self.ids.items()}
        self.history: dict[int, list[tuple[float, str, str]]] = {}
        self.apart: dict[int, bool] = _Recent(_PAIRS)
        self.alone = {p: i for p, i in self.ids.items() if not bpe or len(p) == 1 or self.merges(p)[0] == [p]}  # pieces that are their own encoding
        self.reach: dict[str, int] = {}  # longest piece by its last three characters
        for p in self.alone:
            if len(p) > 2:
                self.reach[p[-3:]] = max(self.reach.get(p[-3:], 2), len(p))
        self.begun = _Recent(_HEADS)
        self.memo = _Memo(self)
        #: whether words are independent, so that a text may be cut into them
        self.by_words = bool(self.heads and "\n" not in known)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+") if self.by_words else re.compile("(?s).+")

    @classmethod
    def load(cls, path: str) -> Model:
        pieces, bpe, dummy = [], False, True
        with open(path, "rb") as f:
            data = f.read()
        for tag, value in _fields(data):
            if tag == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), float(np.frombuffer(p[2], np.float32)[0]) if 2 in p else 0.0, p.get(3, 1)))
            elif tag == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif tag == 3:
                spec = dict(_fields(value))
                dummy = bool(spec.get(3, 1))
                if spec.get(4, 1) or spec.get(2, b""):
                    raise ValueError("only models without normalisation are supported")
        return cls(pieces, bpe, dummy)

    def normal(self, text: str) -> str:
        out = text.replace(" ", SPACE)
        return SPACE + out if self.dummy_prefix and text else out

    # a state is an id, or -1 for a character outside the vocabulary

    def weight(self, before: int, after: int, is_first: bool = False) -> float:
        if not self.bpe:
            return self.floor if after < 0 else self.score[after]
        if is_first or before < 0 or after < 0:
            return 0.0
        key = before << 20 | after
        ok = self.apart.find(key)
        if ok is None:
            ok = self._stay_apart(before, after)
            self.apart.put(key, ok)
        return 0.0 if ok else _NO

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Merge neighbours by the best score, leftmost first: the pieces left, and each merge's score with the outer pieces after it."""
        out = list(text)
        steps = [(0.0, out[0], out[-1])]
        while len(out) > 1:
            best = None
            for i in range(len(out) - 1):
                s = self.value.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                break
            s, i = best
            out[i : i + 2] = [out[i] + out[i + 1]]
            steps.append((s, out[0], out[-1]))
        return out, steps

    def _stay_apart(self, before: int, after: int) -> bool:
        """Whether two pieces side by side are merged on their own only: no merge over their border comes first."""
        for k in (before, after):
            if k not in self.history:
                self.history[k] = self.merges(self.pieces[k])[1]
        a, b, value = self.history[before], self.history[after], self.value.get
        i = j = 0
        while True:
            over = value(a[i][2] + b[j][1], _NO)
            x = a[i + 1][0] if i + 1 < len(a) else _NO
            y = b[j + 1][0] if j + 1 < len(b) else _NO
            if over > x and over >= y:
                return False
            if x == y == _NO:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def usable(self, piece: str) -> int | None:
        """Id of a piece that is its own encoding."""
        return self.alone.get(piece)

    def columns(self, text: str, start: int, stop: int, initial: dict[int, dict[int, np.ndarray | float]]):
        """Best weights of the states ending at each position: {position: {state: weight, or one weight per initial state}}.

        Pieces that begin in start..stop-1 are taken, also those that end behind stop.
        """
        at: dict[int, dict] = {p: dict(s) for p, s in initial.items()}
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for p in range(start, stop):
            here = at.get(p)
            if not here:
                continue
            found = False
            for size in range(1, min(self.longest, len(text) - p) + 1):
                k = self.usable(text[p : p + size])
                if k is None:
                    if size > 1 or found or text[p] in self.ids:
                        continue
                    k = -1
                found = True
                best = None
                for before, value in here.items():
                    w = value + self.weight(before, k)
                    if best is None:
                        best, source = w, before
                    elif isinstance(w, np.ndarray):
                        best = np.maximum(best, w)
                    elif w > best:
                        best, source = w, before
                if np.max(best) == _NO:
                    continue
                at.setdefault(p + size, {})[k] = best
                back[p + size, k] = (p, source)
        return at, back

    def best(self, text: str) -> list[int]:
        """States of the best path of a whole text."""
        if self.bpe:
            return self._only(text)
        at, back = self.columns(text, 0, len(text), {0: {-2: 0.0}})
        return self._trace(at[len(text)], back, len(text), 0)

    def _trace(self, ends: dict, back: dict, end: int, start: int) -> list[int]:
        state = max(ends, key=lambda s: (ends[s], s))
        out = []
        while end > start:
            out.append(state)
            end, state = back[end, state]
        return out[::-1]

    def _only(self, text: str) -> list[int]:
        """As best() for BPE, where each prefix has one encoding only: its last piece and where that begins."""
        n = len(text)
        known = self.begun.find(text[:_HEAD]) if n > _HEAD else None
        last, begin = (known[0][:], known[1][:]) if known else ([-1], [0])
        done = len(last)
        last += [-1] * (n + 1 - done)
        begin += [0] * (n + 1 - done)
        get, apart, reach = self.alone.get, self.apart.get, self.reach.get
        for p in range(done, n + 1):
            low = p - reach(text[p - 3 : p], 2) if p > 2 else 0
            for q in range(low if low > 0 else 0, p):
                k = get(text[q:p])
                if k is None:
                    continue
                before = last[q]
                if q and before >= 0:
                    ok = apart(before << 20 | k)
                    if ok is None:
                        ok = self.weight(before, k) == 0.0
                    if not ok:
                        continue
                last[p], begin[p] = k, q
                break
            else:
                begin[p] = p - 1
        if n > _HEAD and not known:
            self.begun.put(text[:_HEAD], (last[: _HEAD + 1], begin[: _HEAD + 1]))
        out, p = [], n
        while p:
            out.append(last[p])
            p = begin[p]
        return out[::-1]

    def id_bytes(self, text: str, states: list[int]) -> bytes:
        """Ids as little-endian int32; a character outside the vocabulary becomes its bytes."""
        out, p = [], 0
        for k in states:
            if k >= 0:
                out.append(k)
                p += len(self.pieces[k])
            else:
                if self.bytes:
                    out += [self.bytes[b] for b in text[p].encode()]
                else:
                    out.append(self.unk)
                p += 1
        return np.array(out, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian int32. Words are independent where no piece goes on past a space mark."""
        return b"".join(map(self.memo.__getitem__, self.cut.findall(self.normal(text))))

    def encode_slice(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each text's start (with an end mark): each distinct word is looked up once."""
        before = np.concatenate([[10], raw[:-1]])
        cut = ((raw == 32) & (before != 32)) | (raw == 10) | (before == 10)
        words, numbers, first = distinct(raw, off, np.zeros(len(raw), bool), cut)
        ids = [self.memo[w.decode().replace(" ", SPACE)] for w in words]
        numbers = numbers.copy()
        heads = first[:-1][np.diff(first) > 0]  # a text's first word has the mark that is put before the text
        kinds, which = np.unique(numbers[heads], return_inverse=True)
        numbers[heads] = len(words) + which
        ids += [self.encode(words[k].decode()) for k in kinds]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(lengths) - lengths
        ends = np.concatenate([[0], np.cumsum(lengths[numbers])])
        return gather(flat, starts[numbers], lengths[numbers]), ends[first]

    def decode(self, ids: np.ndarray) -> str:
        """Text of an id sequence; bytes that are not UTF-8 become replacement characters, control ids nothing."""
        data, starts, lengths = self.spelling
        text = gather(data, starts[ids], lengths[ids]).tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text

    @property
    def spelling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all ids one behind the other, where each id's start, and how many they are."""
        if not hasattr(self, "_spelling"):
            own = [bytes([self.byte_of[i]]) if i in self.byte_of else " ⁇ ".encode() if self.kind[i] == 2 else b"" if self.kind[i] == 3 else p for i, p in enumerate(self.plain)]
            lengths = np.array([len(b) for b in own])
            self._spelling = np.frombuffer(b"".join(own), np.uint8), np.cumsum(lengths) - lengths, lengths
        return self._spelling

    @property
    def plain(self) -> list[bytes]:
        if not hasattr(self, "_plain"):
            self._plain = [p.replace(SPACE, " ").encode() for p in self.pieces]
        return self._plain

    # chunks of long texts

    def crossing(self, text: str, border: int) -> list[tuple[int, int]]:
        """States (id, characters behind the border) that may cross a border: pieces that begin before it and end at it or behind."""
        out = []
        for size in range(1, self.longest + 1):
            for begin in range(max(0, border - size), border):
                end = begin + size
                if border <= end <= len(text):
                    k = self.usable(text[begin:end])
                    if k is not None:
                        out.append((k, end - border))
        if text[border - 1] not in self.ids:
            out.append((-1, 0))
        return sorted(set(out))

    def transfer(self, text: str, left: int, right: int, last: bool):
        """Transfer matrix of text[left:right]; text has the context of the longest piece around it."""
        rows = self.crossing(text, left) if left else [(-2, 0)]
        initial: dict[int, dict[int, np.ndarray]] = {}
        for r, (k, over) in enumerate(rows):
            value = np.full(len(rows), _NO)
            value[r] = 0.0
            initial.setdefault(left + over, {})[k] = value
        at, _ = self.columns(text, left, right, initial)
        cols = [(-3, 0)] if last else self.crossing(text, right)
        out = np.full((len(rows), len(cols)), _NO)
        for c, (k, over) in enumerate(cols):
            ends = at.get(right + over, {})
            if last:
                for v in ends.values():
                    out[:, c] = np.maximum(out[:, c], v)
            elif k in ends:
                out[:, c] = ends[k]
        return out

    def between(self, text: str, left: int, right: int, last: bool, enter: int, leave: int) -> bytes:
        """Ids of the pieces that begin in text[left:right], between chosen border states."""
        k, over = self.crossing(text, left)[enter] if left else (-2, 0)
        at, back = self.columns(text, left, right, {left + over: {k: 0.0}})
        if last:
            ends, end = at[right], right
        else:
            state, more = self.crossing(text, right)[leave]
            end = right + more
            ends = {state: at[end][state]} if end > left + over or end in at else {}
        if end == left + over:
            return b""
        states = self._trace(ends, back, end, left + over)
        return self.id_bytes(text[left + over :], states)


class _Recent(dict):
    """Two generations of `limit` entries: the older goes when the younger is full, what is used again moves on."""

    def __init__(self, limit: int) -> None:
        self.limit, self.old = limit, {}

    def find(self, key):
        """As get(), in both generations."""
        found = self.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


class _Memo(_Recent):
    """Encodings of words."""

    def __init__(self, model: Model) -> None:
        super().__init__(_MEMO)
        self.model = model

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.model.id_bytes(word, self.model.best(word))
        if len(word) <= 64:
            self.put(word, ids)
        return ids


_models: dict[str, Model] = {}


def _model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model.load(path)
    return _models[path]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """State at each inner border of the best path, from associative prefix and suffix products.

    The products are taken over a balanced tree: each half only needs the
    product of the other.
    """
    out: list[int] = []

    def product(lo: int, hi: int) -> np.ndarray:
        if (lo, hi) not in cache:
            mid = (lo + hi) // 2
            cache[lo, hi] = matrices[lo] if hi - lo == 1 else combine(product(lo, mid), product(mid, hi))
        return cache[lo, hi]

    def solve(lo: int, hi: int, before: np.ndarray, behind: np.ndarray) -> None:
        if hi - lo == 1:
            return
        mid = (lo + hi) // 2
        a, b = combine(before, product(lo, mid)), combine(product(mid, hi), behind)
        solve(lo, mid, before, combine(product(mid, hi), behind))
        state = int(np.argmax(a[0] + b[:, 0]))
        out.append(state)
        fixed = np.full((1, a.shape[1]), _NO)
        fixed[0, state] = 0.0
        solve(mid, hi, fixed, behind)

    cache: dict[tuple[int, int], np.ndarray] = {}
    solve(0, len(matrices), np.zeros((1, 1)), np.zeros((1, 1)))
    return out


def _ids_array(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _encode_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for i, j, raw, off in text_slices(batch.column("text"), _SLICE):
                part = batch.slice(i, j - i)
                mark = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)  # the space mark itself in a text
                if model.by_words and not mark.any():
                    flat, at = model.encode_slice(raw, off)
                    ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                else:
                    ids = _ids_array([model.encode(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), ids], ["doc_id", "key", "ids"])

    return run


def _chunks(path: str, chunk: int):
    """Rows (doc_id, key, no, last, left, right, text): chunks with their context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
                full = model.normal(text)
                rows = []
                for no, a in enumerate(range(0, len(full), chunk)):
                    b = min(a + chunk, len(full))
                    lo = max(0, a - model.longest)
                    rows.append({"doc_id": doc, "key": key, "no": no, "last": b == len(full), "left": a - lo, "right": b - lo, "text": full[lo : b + model.longest]})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("no", pa.int64()), ("last", pa.bool_()), ("left", pa.int32()), ("right", pa.int32()), ("text", pa.string())]))

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            out = [model.transfer_by_words(t, a, b, z) for t, a, b, z in zip(*(batch.column(c).to_pylist() for c in ("text", "left", "right", "last")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("no"), pa.array([m.shape[0] for m in out], pa.int32()), pa.array([m.astype("<f8").tobytes() for m in out], pa.binary())], ["doc_id", "key", "no", "rows", "matrix"])

    return run


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Border states of one text. Its matrices are a few kB for each `chunk` characters."""
    pdf = pdf.sort_values("no")
    matrices = [np.frombuffer(m, "<f8").reshape(r, -1) for m, r in zip(pdf["matrix"], pdf["rows"])]
    states = border_states(matrices)
    return pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "no": pdf["no"], "enter": [0, *states], "leave": [*states, 0]})


def _trace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            ids = [model.between_by_words(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("text", "left", "right", "last", "enter", "leave")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("no"), _ids_array(ids)], ["doc_id", "key", "no", "ids"])

    return run


def _by_words(model: Model, text: str, left: int, right: int) -> tuple[int, int] | None:
    """First and last place in text[left:right] that no piece crosses; None if words aren't independent or there are none."""
    if not model.heads:
        return None
    places = [i for i in (text.find(SPACE, max(left, 1)), ) if 0 < i < right]
    while places and text[places[0] - 1] == SPACE:
        i = text.find(SPACE, places[0] + 1)
        places = [i] if 0 < i < right else []
    if not places:
        return None
    end = text.rfind(SPACE, places[0], right)
    while end > places[0] and text[end - 1] == SPACE:
        end = text.rfind(SPACE, places[0], end)
    return places[0], max(places[0], end)


def _transfer_by_words(self: Model, text: str, left: int, right: int, last: bool) -> np.ndarray:
    """transfer(), with the words between the first and the last inner space mark taken as one known factor."""
    inner = _by_words(self, text, left, right)
    if inner is None or not self.bpe:
        return self.transfer(text, left, right, last)
    a, b = inner
    head = self.transfer(text[:a], left, a, True)
    tail = self.transfer(text[b:], 0, right - b, last)
    return combine(head, tail)


def _between_by_words(self: Model, text: str, left: int, right: int, last: bool, enter: int, leave: int) -> bytes:
    inner = _by_words(self, text, left, right)
    if inner is None or not self.bpe:
        return self.between(text, left, right, last, enter, leave)
    a, b = inner
    head = self.between(text[:a], left, a, True, enter, 0)
    middle = b"".join(map(self.memo.__getitem__, self.cut.findall(text[a:b])))
    return head + middle + self.between(text[b:], 0, right - b, last, 0, leave)


Model.transfer_by_words, Model.between_by_words = _transfer_by_words, _between_by_words


def encode(docs: DataFrame, model: str = MODEL, chunk: int = 32_768) -> DataFrame:
    """Per document: doc_id, key (a hash of doc_id and text), ids array<int>.

    Null and empty texts have no ids. Repeated rows come back as often as they
    are there. Other columns of docs are ignored.
    """
    docs = documents(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    whole = docs.where(F.length("text") < chunk).mapInArrow(_encode_whole(model), "doc_id long, key long, ids array<int>")
    giant = docs.where(F.length("text") >= chunk)
    copies = giant.groupBy("doc_id", "key").agg(F.count("*").alias("copies"))
    giant = giant.dropDuplicates(["doc_id", "key"])
    cut = giant.mapInArrow(_chunks(model, chunk), "doc_id long, key long, no long, last boolean, left int, right int, text string")
    cut = table(cut.repartition("key", "no"))
    matrices = cut.mapInArrow(_matrices(model), "doc_id long, key long, no long, rows int, matrix binary")
    states = matrices.groupBy("doc_id", "key").applyInPandas(_solve, "doc_id long, key long, no long, enter int, leave int")
    on = F.expr("a.doc_id <=> b.doc_id and a.key = b.key and a.no = b.no")
    traced = cut.alias("a").join(states.alias("b"), on).select("a.*", "enter", "leave").mapInArrow(_trace(model), "doc_id long, key long, no long, ids array<int>")
    whole_again = traced.groupBy("doc_id", "key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    again = whole_again.alias("a").join(copies.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.key = b.key")).select("a.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_i")).drop("_i")
    return whole.unionByName(again)


def _decode(path: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                flat, off = part.column("ids").flatten().to_numpy(), part.column("ids").offsets.to_numpy()
                ids = [flat[a - off[0] : b - off[0]] for a, b in zip(off[:-1], off[1:])]
                text = [model.decode(x) for x in ids]
                if keep_text:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(text, pa.string())], ["doc_id", "key", "text"])
                else:
                    sha = lambda b: hashlib.sha256(b).hexdigest()
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.astype("<i4").tobytes()) for x in ids]), pa.array([len(t) for t in text], pa.int64()), pa.array([sha(t.encode()) for t in text])], ["doc_id", "key", "n_ids", "ids_sha256", "n_chars", "text_sha256"])

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Text of each id sequence: doc_id, key, text."""
    return encoded.mapInArrow(_decode(model, True), "doc_id long, key long, text string")


def encode_digests(docs: DataFrame, model: str = MODEL, chunk: int = 32_768) -> DataFrame:
    """Encoded and decoded again: doc_id, n_ids, ids_sha256 (of little-endian int32), n_chars and text_sha256 of the decoded text."""
    out = encode(docs, model, chunk).mapInArrow(_decode(model, False), "doc_id long, key long, n_ids long, ids_sha256 string, n_chars long, text_sha256 string")
    return out.drop("key")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"))

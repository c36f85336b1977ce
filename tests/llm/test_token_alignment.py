import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from voxelspark.llm import token_alignment as T

tokenizers = pytest.importorskip("tokenizers")
WORDS = ["alpha", "it's", "'sand", "Straße", "é", "́x", "<|endoftext|>", "12345", "...", "日本語", "🙂👍", "x" * 200, "a　", "b ", "naïve", "</s>", "<0x41>", " ", "tab\t", "the", "the", "the", "of"]
ODD = ["▁", "\x00", "�", "a▁b"]


def texts(n, seed=1, words=WORDS):
    rng = random.Random(seed)
    return ["".join(rng.choice(words) + rng.choice(["", " ", " ", " ", "  ", "\n", " \n", "\r\n ", "  ", "\x1c "]) for _ in range(rng.choice([1, 5, 60]))) for _ in range(n)]


def brute(rows):
    """Directly from the statement: whole texts through both libraries."""
    import sentencepiece

    a_path, b_path = T.default_models()
    a, b = tokenizers.Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    letters = tokenizers.pre_tokenizers.ByteLevel.alphabet()
    known = T.byte_alphabet()
    assert set(letters) == set(known)
    out, held = [], []
    for doc_id, text in rows:
        text = text or ""
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xb = [bytes(known[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        whole = (" " + text).encode()
        if not text or b"".join(xb) != whole or b"".join(yb) != whole:
            out.append([doc_id, 0, 0, 0, 0, ""])
            held.append([])
            continue
        xe, ye = np.cumsum([len(t) for t in xb]).tolist(), np.cumsum([len(t) for t in yb]).tolist()
        ends = sorted(set(xe) & set(ye))
        parts, links, lo = [], [], 0
        for hi in ends:
            own, other = [i for i, e in zip(x, xe) if lo < e <= hi], [i for i, e in zip(y, ye) if lo < e <= hi]
            parts.append(",".join(map(str, own)) + "|" + ",".join(map(str, other)))
            links += [(i, j) for i in own for j in other]
            lo = hi
        out.append([doc_id, len(x), len(y), len(ends), len(links), hashlib.sha256(";".join(parts).encode()).hexdigest()])
        held.append(links)
    count = Counter(p for links in held for p in set(links))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    return [tuple([*r, sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links)]) for r, links in zip(out, held)]


def got(spark, rows, parts=5):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, Run int, heads string").repartition(parts)
    out = T.alignment(df)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_against_whole_texts(spark):
    rows = list(enumerate([*texts(150), *texts(40, 2, WORDS + ODD), None, "", " ", "  a", "a ", " a b", "word " * 30_000 + "end", "the of", "the of"]))
    assert got(spark, rows) == sorted(brute(rows), key=repr)


def test_salts(spark, monkeypatch):
    """Runs of one radix by several salts, fewer tasks than salts and sides."""
    monkeypatch.setattr(T, "RUNS", 2)
    monkeypatch.setattr(T, "SIDES", 3)
    rows = list(enumerate(texts(120, 3)))
    assert got(spark, rows, 3) == sorted(brute(rows), key=repr)


def test_small_slices_heaps_and_flushes(monkeypatch):
    """The tasks' own functions, one after the other in this process, with bounds so small that each is met."""
    for name, value in (("FAN", 2), ("_SLICE", 400), ("_KNOWN", 5), ("_PIECES", 7), ("_JOIN", 3), ("_SUMS", 40), ("_ROWS", 20)):
        monkeypatch.setattr(T, name, value)
    rows = list(enumerate([*texts(120, 3), None, "", "a" * 1000, " b" * 900, "x▁y"]))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    spill = [r for b in T._spill(T.default_models())(iter([batch])) for r in b.to_pylist()]
    docs, runs = {(r["run"], r["local"]): r for r in spill if r["local"] is not None}, [r for r in spill if r["local"] is None]
    assert len({r["run"] for r in runs}) > 10

    def batches(found, schema, size=7):
        return iter([pa.RecordBatch.from_pylist(found[k : k + size], schema) for k in range(0, len(found), size)])

    schema = pa.schema([("radix", pa.int32()), ("salt", pa.int32()), ("run", pa.int64()), ("docs", pa.int32()), ("heads", pa.binary()), ("tails", pa.binary())])
    held = [{**r, "salt": r["run"] % 2} for r in runs]
    counts = [r for b in T._count(False)(batches(sorted(held, key=lambda r: (r["radix"], r["salt"])), schema)) for r in b.to_pylist()]
    counts = [r for b in T._count(True)(batches([{**r, "salt": 0} for r in counts], schema)) for r in b.to_pylist()]
    assert len(counts) == len({r["radix"] for r in runs})
    stream = [{**r, "salt": k, "run": None, "docs": 0, "tails": None} for r in counts for k in (0, 1)] + held
    stream.sort(key=lambda r: (r["salt"], r["radix"], r["run"] is not None))
    sums = Counter()
    for b in T._send_back(batches(stream, schema)):
        for r in b.to_pylist():
            sums[r["run"], r["local"], "n_best"] += r["n_best"]
            sums[r["run"], r["local"], "count_sum"] += r["count_sum"]
    out = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], sums[(*k, "n_best")], sums[(*k, "count_sum")]) for k, r in docs.items()]
    assert sorted(out) == sorted(brute(rows))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "a b"), (None, "a b"), (1, "a b"), (1, "a c"), *[(2, "the same text")] * 60]
    assert got(spark, rows) == sorted(brute(rows), key=repr)
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


def test_merge_and_runs():
    rng = np.random.default_rng(1)
    held = []
    for _ in range(200):
        p = np.unique(rng.integers(0, 500, rng.integers(1, 60))).astype(np.uint32)
        held.append((p, rng.integers(1, 5, len(p))))
    pair, n = T.merge(held)
    want = Counter()
    for p, k in held:
        want.update(dict(zip(p.tolist(), k.tolist())))
    assert dict(zip(pair.tolist(), n.tolist())) == dict(want) and (np.diff(pair.astype(int)) > 0).all()
    links = rng.integers(0, 5, 3000).astype(np.uint32) << np.uint32(16) | rng.integers(0, 9, 3000).astype(np.uint32)
    where, back = rng.integers(0, 30, 3000), Counter()
    for r, heads, tails in T.runs(links, where):
        (step, docs), (doc, times) = T._unpack(heads, 2), T._unpack(tails, 2)
        for p, d, k in zip(np.repeat(np.cumsum(step), docs).tolist(), doc.tolist(), times.tolist()):
            assert (p >> 16) % T.RADIX == r
            back[p, d] += k
    assert back == Counter(zip(links.tolist(), where.tolist()))

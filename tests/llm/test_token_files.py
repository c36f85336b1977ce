import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from voxelspark.llm import token_files as T
from voxelspark.llm.common import shared_folder

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, tie string, copy long, Part int"
WORDS = ["alpha", "it's", "'sand", "don't", "Straße", "ΣΟΦΟΣ", "é", "́x", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "A<|STARTOFTEXT|>B,c<|", "IT'S", "x'sY", "a1b22", "don't've", "''s", ",'s", "K'LLx", "_A_b", "e\u0301A", "A\u0301", "#tag", "12345", "...", "\x00", " ", "日本語", "🙂👍", "ﬁ", "x" * 300]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [rng.choice(["", " ", "\n"]).join(rng.choice(WORDS) + rng.choice(["", " ", "\t", "\r\n", "  ", "\x0b", " "]) for _ in range(rng.choice([0, 1, 5, 80]))) for _ in range(n)]


def brute(rows):
    model = tokenizers.Tokenizer.from_file(T.default_model())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def made(spark, rows, parts=7):
    """A table on disk, with columns named like the helpers."""
    path = shared_folder(spark)
    spark.createDataFrame([(i, t, "t", 1, 2) for i, t in rows], SCHEMA).repartition(4).write.parquet(path)
    root = shared_folder(spark)
    T.write_tokens(spark.read.parquet(path), root, parts=parts)
    return root


def test_ids_are_the_library_s(spark):
    rows = [(7 * i - 300, t) for i, t in enumerate([*texts(200), None, "", " \n ", "longest " * 200_000])]
    root = made(spark, rows)
    got = [tuple(r) for r in T.token_digests(spark, root).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows)
    assert T.manifest(spark, root).count() > 3
    ids = {r.doc_id: r.ids for r in T.read_tokens(spark, root).collect()}
    model = tokenizers.Tokenizer.from_file(T.default_model())
    assert all(ids[i] == model.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows)


def test_repeated_rows_and_null_ids(spark):
    """Equal rows and rows without doc_id are all there, and offsets follow one another."""
    rows = [(None, "no id"), (None, "no id"), (3, "b a"), (3, "a"), *[(5, "same")] * 50, (-9, None)]
    got = sorted((tuple(r) for r in T.token_digests(spark, made(spark, rows)).collect()), key=lambda r: r[1])
    want = brute(rows)
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((r[0], r[2], r[3]) for r in want if r[0] is not None)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()


def test_empty_table(spark):
    root = made(spark, [])
    assert T.token_digests(spark, root).count() == 0 and T.read_tokens(spark, root).count() == 0 and T.manifest(spark, root).count() == 0


def test_files_of_other_attempts_and_broken_files(spark):
    root = made(spark, [(i, f"word {i}") for i in range(40)], parts=3)
    path = root.removeprefix("file://")
    row = T.manifest(spark, root).orderBy("part").first()
    with open(f"{path}/part-00000000-other.ids", "wb") as f:
        f.write(b"\1")
    assert T.token_digests(spark, root).count() == 40
    assert T.mapped(root, row["name"], "ids", row["width"]).dtype == np.dtype("<u2")
    with open(f"{path}/{row['name']}.ids", "ab") as f:
        f.write(b"\1\0")
    with pytest.raises(Exception, match="manifest"):
        T.token_digests(spark, root).agg(F.count("*")).collect()


def test_forgotten_pieces(monkeypatch):
    monkeypatch.setattr(T, "_KNOWN", 3)
    e = T.Encoder(T.default_model())
    for some in (["a b c d e"], ["e f", "", "a"], ["g"], ["a b"]):
        raw = np.frombuffer("".join(some).encode(), np.uint8)
        ids, at = e.encode(raw, np.cumsum([0, *map(len, some)]))
        want = [e.model.encode(t, add_special_tokens=False).ids + [2] for t in some]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want

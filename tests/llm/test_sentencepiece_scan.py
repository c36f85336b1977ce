import hashlib
import itertools
import random

import numpy as np
import pytest
import sentencepiece

from voxelspark.llm.sentencepiece_scan import MODEL, Model, border_states, decode, encode, encode_digests

SCHEMA = "doc_id long, text string, key string, ids string"


@pytest.fixture(scope="module")
def model():
    return Model.load(MODEL)


def texts(seed=1):
    rng = random.Random(seed)
    syllables = ["tion", "ou", "é", "ñ", "ß", "the", "ing", "A", "x", "日", "本", "\U0001f600", "ﬁ", "\x00", "12", ".", "'"]
    out = ["", " ", "a", "  a  b   ", "\n\n x\t\r\n", "▁▁ ▁", " " * 40, "é" * 50, "aaaaaaaaaaaaaaaaaaaaaaaaaa", "ＡＢ"]
    for _ in range(300):
        out.append("".join(rng.choice(syllables + [" ", " ", "\n", "   "]) for _ in range(rng.randrange(1, 60))))
    return out


def test_ids_equal_the_library(model):
    ref = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in texts():
        assert np.frombuffer(model.encode(t), "<i4").tolist() == ref.encode(t), t
        assert model.decode(np.frombuffer(model.encode(t), "<i4")) == t.replace("▁", " ")


def chunked(model, text, size):
    full, cuts = model.normal(text), []
    for a in range(0, len(full), size):
        b, lo = min(a + size, len(full)), max(0, a - model.longest)
        cuts.append((full[lo : b + model.longest], a - lo, b - lo, b == len(full)))
    states = border_states([model.transfer_by_words(*c) for c in cuts])
    return b"".join(model.between_by_words(*c, e, x) for c, e, x in zip(cuts, [0, *states], [*states, 0]))


@pytest.mark.parametrize("size", [1, 3, 17, 50])
def test_chunks_equal_whole(model, size):
    for t in texts(2)[:80]:
        assert chunked(model, t, size) == model.encode(t) if t else True, (t, size)


def test_unigram_against_all_segmentations():
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "ab", "abc", "bc", "ca", "▁", "▁a", "cab", "bb"]
    m = Model([("<unk>", 0.0, 2)] + [(p, -rng.random() * 5, 1) for p in vocabulary], bpe=False)
    for _ in range(40):
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 11)))
        full = m.normal(t)

        def value(cut):
            parts = [full[i:j] for i, j in zip(cut, cut[1:])]
            return sum(m.score[m.ids[p]] for p in parts) if all(p in m.ids for p in parts) else -1e9

        best = max(value((0, *c, len(full))) for r in range(len(full)) for c in itertools.combinations(range(1, len(full)), r))
        for ids in (m.encode(t), chunked(m, t, 3)):
            got = np.frombuffer(ids, "<i4").tolist()
            assert "".join(m.pieces[i] for i in got) == full
            assert abs(sum(m.score[i] for i in got) - best) < 1e-9


def test_spark_round_trip(spark, model):
    rows = [*enumerate(texts(3)), (900, None), (901, texts(3)[20]), (901, texts(3)[20]), (None, "a b")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    got = encode(df, chunk=20)
    assert got.count() == len(rows)
    want = {(d, hashlib.sha256(model.encode(t or "")).hexdigest()) for d, t in rows}
    assert {(r.doc_id, r.ids_sha256) for r in encode_digests(df, chunk=20).collect()} == want
    assert {(r.doc_id, r.text) for r in decode(got).collect()} == {(d, (t or "").replace("▁", " ")) for d, t in rows}
    assert encode(df.limit(0)).count() == 0


def test_slices_of_texts_are_cut_into_words():
    """Texts side by side in one slice, with space and line ends at their borders, get the ids that each has alone."""
    rng = random.Random(8)
    model = Model.load(MODEL)
    texts = ["".join(rng.choice(["a", "word", " ", "  ", "\n", "é", "日本", "\t", "x" * 70, "<s>", "\x00"]) for _ in range(rng.choice([0, 1, 2, 30]))) for _ in range(400)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, at = model.encode_slice(raw, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    for t, a, b in zip(texts, at[:-1], at[1:]):
        assert ids[a:b].astype("<i4").tobytes() == model.encode(t)
        assert model.decode(ids[a:b]) == t

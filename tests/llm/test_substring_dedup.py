import hashlib
import random
import re

from voxelspark.llm.substring_dedup import SuffixAutomaton, substring_dedup

SCHEMA = "doc_id long, text string, source string"


def brute(rows, window):
    seen, removed, words = set(), {}, {}
    for doc, text in sorted((d, t or "") for d, t in rows):
        w = re.findall("[^\x20\x09-\x0d]+", text)
        words[doc], cut = w, set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                cut.update(range(i, i + window))
            seen.add(key)
        removed[doc] = cut
    return {d: (len(w), len(removed[d]), " ".join(x for i, x in enumerate(w) if i not in removed[d])) for d, w in words.items()}


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(40)] + ["a", "The", "the"]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            k = rng.randrange(0, len(w) + 1)
            a = rng.randrange(0, 25)
            w[k:k] = passage[a : a + rng.randrange(5, 50)]
        if i % 7 == 0:
            w = w + ["again"] * rng.randrange(30)
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(w)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, ""), (n + 3, None), (n + 4, " \n ")]
    near = rows[6][1].split()
    for i in range(20):
        m = list(near)
        if m:
            m[rng.randrange(len(m))] = "edited"
        rows.append((n + 5 + i, " ".join(m)))
    return rows


def check(spark, rows, window, **options):
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup(df, window, **options).collect()}
    assert got == brute(rows, window)


def test_against_brute_force(spark):
    check(spark, corpus(), 20)


def test_small_window_full_bitmap_and_split_shards(spark):
    check(spark, corpus(9), 8, gram=3, log2_bits=8, shard_contexts=2)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(empty).count() == 0
    df = spark.createDataFrame([(None, "a b " * 30, "s"), (None, "a b " * 30, "s")], SCHEMA)
    assert {(r.n_words, r.n_removed) for r in substring_dedup(df).collect()} == {(60, 0)}


def test_automaton():
    rng = random.Random(2)
    for _ in range(30):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(4)]
        a = SuffixAutomaton()
        for t in texts:
            a.add(t)
        q = [rng.randrange(3) for _ in range(15)]
        inside = lambda s: any(t[i : i + len(s)] == s for t in texts for i in range(len(t) - len(s) + 1))
        want = [max(k for k in range(i + 2) if k == 0 or inside(q[i + 1 - k : i + 1])) for i in range(len(q))]
        assert a.matching(q) == want

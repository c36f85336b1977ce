import os
import random
import re

import pytest

from voxelspark.llm.minhash_dedup import near_dedup, op6_minhash_dedup

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, k, num, den):
    sets = {}
    for d, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = len(sets[a] & sets[b])
            if same and den * same >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def corpus(seed, n_base=12, copies=14):
    rng = random.Random(seed)
    vocabulary = [f"Wort{i}" for i in range(300)]
    rows = []
    for _ in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 8, 40, 120]))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w) if rng.random() < 0.8 else "\n".join(w).upper())
    rows += ["", None, " \t", "a", "A", "a b", "ab"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def check(spark, rows, k, num, den, **options):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(df, k, num, den, **options).collect()}
    assert got == brute(rows, k, num, den)


def test_against_brute_force(spark):
    check(spark, corpus(1), 3, 85, 100)


def test_large_nodes(spark):
    check(spark, corpus(2, 3, 60), 5, 80, 100, leaf=4, block=8)


def test_empty_table_and_null_id(spark):
    assert near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", None), (1, "a b c d e f", "x"), (1, "a b c d e f", "y")], SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True)]


def test_texts_of_one_doc_id_are_classes_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, c), (4, c + " end")] + [(4, c)] * 200
    got = near_dedup(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(4)).collect()
    assert sorted({(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}) == [(1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 56, 4, True), (4, 57, 4, True)]
    rows = [(1, a), (2, a + " end"), (2, b)]
    got = near_dedup(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 56, 1, True), (2, 56, 2, True), (2, 57, 1, False)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_groups_of_a_given_table_are_those_of_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op6_minhash_dedup(spark, SF).collect()}
    assert got == brute(rows, 3, 85, 100) and any(not r[2] for r in got.values())

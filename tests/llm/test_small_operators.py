import hashlib
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from voxelspark.llm import chat_format, sharding, transport_stream
from voxelspark.llm.common import shared_folder
from voxelspark.llm.decontamination import leaks
from voxelspark.llm.quality import quality_sample, top_k
from voxelspark.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, source string"
HARD = ["", "\\### Assistant: </turn> ok", "### ", "\\\\</turn>\n", "a\\", "##", "</turn>", "### a: b\n</turn>\n", "</tu\\rn>", "é\n", "\\", "### ###", "%3a"]


@pytest.mark.parametrize("text", HARD)
@pytest.mark.parametrize("role", ["user", "", "a: b", "###", "x\\", "</turn>", "%20"])
def test_turn_round_trip(role, text):
    out, a, b = chat_format.render(role, text)
    assert chat_format.parse(out) == [(role, text)]
    assert chat_format.unescape(out[a:b]) == text
    both = out + chat_format.render("user", "\\")[0]
    assert chat_format.parse(both) == [(role, text), ("user", "\\")]


def test_conversations(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([*HARD, None])) for c in [1, 2, 3, None] for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(df)).collect()}
    assert len(got) == 4
    for c in (1, 2, 3, None):
        own = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[c]
        assert r.n_turns == 9 and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in own).encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_chat(df.limit(0))).count() == 0


def test_transport_stream():
    rng = random.Random(1)
    for n in [0, 1, 150, 575, 576, 577, 11_519, 11_520, 11_521, 12_096, 100_000]:
        text = rng.randbytes(n)
        payload = transport_stream.to_payload(text)
        assert len(payload) % 576 == 0 and payload and payload.rstrip(b"\xff") == text.rstrip(b"\xff")
        media = transport_stream.mux(payload)
        back, info = transport_stream.demux(media)
        assert back == payload and info["continuity_errors"] == 0 and len(media) % 188 == 0
        units = -(-len(payload) // transport_stream.UNIT)
        assert info["pts"] == [u * 3600 for u in range(units)] and info["random_access"] == list(range(0, units, 8))
    broken = bytearray(media)
    broken[188 * 10] = 0
    with pytest.raises(ValueError):
        transport_stream.demux(bytes(broken))
    with pytest.raises(ValueError):
        transport_stream.demux(media[: 188 * 20] + media[188 * 21 :])


def test_media_columns(spark):
    df = spark.createDataFrame([(1, "x" * 5000, "s"), (2, None, "s"), (2, "é", None), (None, "é", "s")], SCHEMA)
    got = transport_stream.decode_media(transport_stream.encode_media(df)).collect()
    assert sorted((r.doc_id or 0, bytes(r.payload).rstrip(b"\xff").decode(), r.n_bytes) for r in got) == [(0, "é", 2), (1, "x" * 5000, 5000), (2, "", 0), (2, "é", 2)]


def brute_leaks(docs, items, k=5):
    grams = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            a = Counter(grams(v))
            for s in range(len(w) - len(v) + 1):
                b = Counter(grams(w[s : s + len(v)]))
                same, total = sum((a & b).values()), sum((a | b).values())
                if v and 5 * same >= 4 * total:
                    out.add((d, i))
                    break
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_leaks(spark, block_words):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(30)] + ["The", "É"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 14, 30, 30, 50])))) for i in range(12)] + [(90, ""), (91, None), (92, items_text := "a a a a a a a a a a")]
    docs = []
    for d in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            x = rng.choice(items[:12])[1].split()
            for _ in range(rng.randrange(0, 3)):
                x[rng.choice([0, len(x) - 1, rng.randrange(len(x))])] = "edited"
            k = rng.randrange(len(w) + 1)
            w[k:k] = x
        docs.append((d, rng.choice([" ", "\n"]).join(w).upper() if d % 3 == 0 else " ".join(w)))
    docs += [(200, None), (201, ""), (202, items_text + " a a")]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in leaks(df, bench, block_words=block_words).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items)
    assert leaks(df.limit(0), bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_leaks_of_texts_shorter_than_the_item(spark, block_words):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 5, 8, 9, 10, 14, 30, 50, 50, 200])] + [(20, "a " * 12)]
    docs = []
    for i, x in items:
        w = x.split()
        docs += [(100 * i + cut, " ".join(w[cut // 2 : len(w) - (cut + 1) // 2])) for cut in range(15)]
        docs += [(100 * i + 50 + cut, " ".join(w[:-cut])) for cut in range(1, 15)]
        docs.append((100 * i + 99, " ".join([*w[: len(w) // 2], "edited", *w[len(w) // 2 + 1 : -1]])))
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    want = brute_leaks(docs, items)
    full = len(want)
    for d, t in docs:
        for i, x in items:
            w, v = t.split(), x.split()
            a, b = bag(w), bag(v)
            if len(w) < len(v) and 5 * (a & b).total() >= 4 * (a | b).total():
                want.add((d, i))
    assert len(want) > full + 50 and (701, 7) in want
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], SCHEMA).repartition(3)
    got = leaks(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) and {(r.doc_id, r.item_id) for r in got} == want
    assert {(r.start_word, r.n_words, round(r.similarity, 6)) for r in got if (r.doc_id, r.item_id) == (751, 7)} == {(0, 49, round(45 / 46, 6))}


def test_large_benchmark_stays_off_the_driver(spark, monkeypatch):
    from voxelspark.llm import decontamination

    def on_driver(*_):
        raise AssertionError("items built on the driver")

    df = spark.createDataFrame([(1, "a b c d e f g h", "s"), (1, "other", "s"), (None, "A b c d e f g h", "s")], SCHEMA)
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h i"), (2, "x y")] * 20, "item_id long, text string")
    monkeypatch.setattr(decontamination.Items, "__init__", on_driver)
    got = leaks(df, bench, block_words=20)
    monkeypatch.undo()
    assert sorted((r.doc_id or 0, r.item_id, r.similarity) for r in got.collect()) == [(0, 1, 1.0), (1, 1, 1.0)]


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.choice([rng.randrange(5), rng.random() * 1e6, 3.0]))) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, x double")
    for k in (0, 1, 700, 1999, 2000, 3000):
        got = {(r.i, r.x) for r in top_k(df, "x", [df["i"]], k, bins=7, few=10).collect()}
        assert got == set(sorted(rows, key=lambda r: (-r[1], r[0]))[:k])


def test_quality_and_toxicity(spark):
    rng = random.Random(8)
    good, bad = [f"good{i}" for i in range(30)], [f"junk{i}" for i in range(30)]
    docs, labels = [], []
    for d in range(300):
        toxic = d % 4 == 0
        w = [rng.choice(bad if d % 3 == 0 else good) for _ in range(40)]
        if toxic:
            w[::8] = [f"mor{rng.choice(['on', 'oon', 'onic', 'ron'])}"] * 5
        docs.append((d, " ".join(w)))
        labels.append((d, int(d % 3 != 0), int(toxic)))
    docs += [(900, None), (901, ""), (None, "mor mor moron " * 5), (None, "good1")]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], SCHEMA).repartition(3)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    kept = [r.doc_id for r in quality_sample(df, lab, fraction=0.5).collect()]
    assert len(kept) == round(0.5 * len(docs)) and sum(d is not None and d < 900 and d % 3 != 0 for d in kept) > 0.9 * min(200, len(kept))
    assert quality_sample(df.limit(0), lab).count() == 0 and quality_sample(df, lab.limit(0)).count() == round(0.5 * len(docs))
    got = toxicity(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert len(held) > 50 and right > 0.95 * len(held)
    assert {r.score for r in toxicity(df, lab.limit(0)).collect()} == {0.0}


def test_toxicity_sample_is_of_documents(spark):
    from voxelspark.llm.toxicity import SubwordSoftmax, sample

    df = spark.createDataFrame([(d, f"text {d}", "s") for d in range(60)] + [(7, f"again {i}", "s") for i in range(300)], SCHEMA).repartition(5)
    labels = [(d, d % 2) for d in range(60)] + [(d, d % 2) for d in range(60) for _ in range(200 if d < 20 else 0)] + [(20, 1), (22, 1), (22, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").repartition(3)
    got = [(r.doc_id, r.toxic, r.text) for r in sample(df, lab, 8).collect()]
    assert len(got) == len({g[0] for g in got}) == 16 and sum(g[1] for g in got) == 8
    every = {r.doc_id: (r.toxic, r.text) for r in sample(df, lab, 1000).collect()}
    import zlib

    left = [d for d in range(60) if zlib.crc32(str(d).encode()) % 3 != 1 and d != 20]
    assert every == {d: (1 if d == 22 else d % 2, "again 0" if d == 7 else f"text {d}") for d in left}
    rng, folded = random.Random(4), []
    monkey = SubwordSoftmax.fit
    try:
        SubwordSoftmax.fit = lambda self, texts, *a, **b: (folded.append(len(texts)), setattr(self, "scale", 1), setattr(self, "shift", 0), setattr(self, "slope", 1), self)[-1]
        for n in (30, 1200):
            import numpy as np

            SubwordSoftmax.calibrated([rng.choice("abc") * 5 for _ in range(n)], np.arange(n) % 2, 2000)
    finally:
        SubwordSoftmax.fit = monkey
    assert folded == [30, 20, 20, 20, 1200, 800, 800, 800]


def test_sharding(spark):
    rows = [(i % 90, f"text {i}" if i % 7 else None, "s") for i in range(400)] + [(None, "", None), (None, "", None), (1, "long " * 300_000, "s")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    root = shared_folder(spark)
    out = sharding.shard_documents(df, root, arrivals=9, smallest=1 << 10, fan=3)
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == Counter(rows)
    found = sharding.versions(spark, root)
    tiers = Counter(s.tier for s in sharding.manifest(spark, root).collect())
    assert len(found) >= 3 and all(n < 3 for n in tiers.values())
    # every version still has all rows
    for v in found:
        assert sum(s.docs for s in sharding.manifest(spark, root, v).collect()) == len(rows)
        assert sharding.shards(spark, root, df.schema, v).count() == len(rows)
    assert sharding.shard_documents(df.limit(0), shared_folder(spark)).count() == 0
    clash = df.withColumn("_batch", F.lit(1)).withColumn("batch", F.lit(2))
    assert sharding.shard_documents(clash, shared_folder(spark), 4).columns[1:] == [*clash.columns, "tier"]
    with pytest.raises(ValueError):
        sharding.shard_documents(df.withColumn("Shard", F.lit(1)), shared_folder(spark))


def test_two_writers_lose_nothing(spark, monkeypatch):
    root, one = shared_folder(spark), lambda i: spark.createDataFrame([(i, f"text {i}", "s")], SCHEMA)
    ids = lambda: sorted(r.doc_id for r in sharding.shards(spark, root, one(0).schema).collect())
    sharding.append(one(1), root)
    true_commit, late = sharding.commit, []

    def interrupted(session, live, where, base):
        if not late:  # another writer commits between this one's reading and its commit
            late.append(1)
            sharding.append(one(3), root)
        return true_commit(session, live, where, base)

    monkeypatch.setattr(sharding, "commit", interrupted)
    sharding.append(one(2), root)
    assert ids() == [1, 2, 3]
    with pytest.raises(FileExistsError):
        true_commit(spark, [], root, 0)
    late.clear()
    sharding.compact(spark, root, one(0).schema, fan=3)  # while 3 is appended once more
    assert ids() == [1, 2, 3, 3]


def test_vacuum_spares_what_is_in_use(spark, monkeypatch):
    root, one = shared_folder(spark), lambda i: spark.createDataFrame([(i, f"text {i}", "s")], SCHEMA)
    for i in range(4):
        sharding.append(one(i), root)
    before = sharding.newest(spark, root)
    true_add = sharding._add

    def vacuumed(session, rows, where):  # the shard is written and not yet committed
        sharding.vacuum(session, where)
        return true_add(session, rows, where)

    monkeypatch.setattr(sharding, "_add", vacuumed)
    sharding.append(one(9), root)
    sharding.compact(spark, root, one(0).schema)
    assert sharding.shards(spark, root, one(0).schema).count() == 5
    assert sharding.shards(spark, root, one(0).schema, before).count() == 4
    assert sharding.vacuum(spark, root, keep=1, age_s=-10) == 4
    assert sharding.shards(spark, root, one(0).schema).count() == 5


def test_a_file_of_one_row_group_makes_many_arrivals(spark):
    """Arrivals follow the rows, not the layout of the files; two tiers are merged and only live shards stay."""
    path, root = shared_folder(spark), shared_folder(spark)
    rows = [(i, f"text {i % 90}", "s") for i in range(1000)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    sharding.append_dealt(docs, root, 63)
    first = sharding.manifest(spark, root).collect()
    assert len(first) == 16 and {s.tier for s in first} == {0} and max(s.docs for s in first) == 63
    sharding.compact(spark, root, docs.schema)
    assert sharding.newest(spark, root) == 6  # four merges of the first tier and one of the second
    assert [(s.tier, s.docs) for s in sharding.manifest(spark, root).collect()] == [(2, 1000)]
    assert sorted(map(tuple, sharding.shards(spark, root, docs.schema).select("doc_id", "text", "source").collect())) == rows
    assert sharding.shards(spark, root, docs.schema, 1).count() == 1000
    root = shared_folder(spark)
    out = sharding.shard_documents(docs, root, age_s=0)
    assert sharding.versions(spark, root) == [6] and {r.tier for r in out.select("tier").collect()} == {2}
    left = spark.read.parquet(*[f"{root}/shards/{s.shard}" for s in sharding.manifest(spark, root).collect()])
    assert left.count() == out.count() == 1000


def test_orphans_of_lost_commits_go(spark):
    root = shared_folder(spark)
    df = spark.createDataFrame([(1, "a", "s")], SCHEMA)
    sharding.append(df, root)
    df.write.parquet(f"{root}/aside/lost")
    sharding.vacuum(spark, root, age_s=-10)
    fs, p = sharding._fs(spark, f"{root}/aside/lost")
    assert not fs.exists(p) and sharding.shards(spark, root, df.schema).count() == 1


def test_labelled_rows_of_a_filter_that_cannot_tell(spark, monkeypatch):
    """With a bitmap of one word most ids may hit; the rows are those of a plain semi-join all the same, null ids left out."""
    from voxelspark.llm import quality

    few = lambda f: lambda *a, **k: f(*a, **{**k, "log2_words": 0})
    monkeypatch.setattr(quality, "hit_words", few(quality.hit_words))
    monkeypatch.setattr(quality, "may_hit", few(quality.may_hit))
    docs = spark.createDataFrame([(i % 300, f"t{i}") for i in range(600)] + [(None, "x")], "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(0, 400, 7)], "doc_id long")
    want = sorted(map(tuple, docs.join(good, "doc_id", "left_semi").collect()))
    assert sorted(map(tuple, quality._labelled(docs, good).collect())) == want and want

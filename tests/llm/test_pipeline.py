import random
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_minhash_dedup import brute as brute_near
from tests.llm.test_small_operators import brute_leaks
from voxelspark.llm.toxicity import _spans, ngram_buckets, train

SCHEMA = "doc_id long, text string, source string"


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_decisions_are_by_row(spark, tmp_path):
    rng = random.Random(5)
    clean = [" ".join(rng.choice([f"good{i}" for i in range(40)]) for _ in range(30)) for _ in range(150)]
    toxic = [" ".join(rng.choice(["moron", "moroon", "moronic", "good1"]) for _ in range(30)) for _ in range(60)]
    item = " ".join(f"leak{i}" for i in range(40))
    labelled = [(i, t, "s") for i, t in enumerate(clean + toxic)]
    rows = [*labelled, (None, "moron moroon moronic " * 10, "s"), (None, clean[0] + " end", "s"), (None, item, "s"), (5, "moronic moron moroon " * 10, "t"), (6, f"{clean[6]} {item}", "t"), (None, None, "s")]
    rows.append((900, item.rsplit(" ", 1)[0], "s"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.createDataFrame([(i, int(i >= len(clean))) for i in range(len(labelled))], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")

    model = train(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def toxic_text(text):
        x = ngram_buckets(np.frombuffer((text or "").encode(), np.uint8))
        margin = model._margins(x, _spans(len(x), 2000), model.table()).max()
        return 1 / (1 + np.exp(-(model.shift + model.slope * margin))) >= 0.7

    want = Counter(r for r in rows if not toxic_text(r[1]))
    assert [r for r in rows if r[0] in (None, 5) and "moro" in (r[1] or "") and r in want] == [] and rows[5] in want
    assert rows_of(corpus_pipeline.drop_toxic(spark, df, str(tmp_path))) == want
    found = {t for t, _ in brute_leaks([(r[1], r[1]) for r in rows], [(1, item)])} | {rows[-1][1]}
    assert rows_of(corpus_pipeline.drop_leaks(spark, df, str(tmp_path))) == Counter(r for r in rows if r[1] not in found)

    single = [r for r in rows if r[0] not in (None, 5, 6)] + [(1000, clean[3] + " more", "s")]
    one = spark.createDataFrame(single, SCHEMA).repartition(3)
    kept = brute_near([r[:2] for r in single], 5, 80, 100)
    assert rows_of(corpus_pipeline.drop_near_duplicates(spark, one, str(tmp_path))) == Counter(r for r in single if kept[r[0]][2])
    lines = brute_lines([r[:2] for r in single])
    assert rows_of(corpus_pipeline.drop_lines(spark, one, str(tmp_path))) == Counter((d, lines[d][0], s) for d, _, s in single)


def test_texts_of_one_doc_id_are_decided_apart(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near, "s"), (2, near + " end", "s"), (2, "quite another text of its own kind", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(corpus_pipeline.drop_near_duplicates(spark, df, "")) == Counter([rows[0], rows[2]])

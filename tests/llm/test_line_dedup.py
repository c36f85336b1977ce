import random

from pyspark.sql import functions as F

from voxelspark.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, token string, place long"


def tokens(line):
    for c in "\t\r\x0b\x0c":
        line = line.replace(c, " ")
    return frozenset(x for x in line.lower().split(" ") if x)


def brute(rows):
    seen, out = [], {}
    for d, t in sorted(rows):
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            s = tokens(line)
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone += 1
            else:
                kept.append(line)
            if s:
                seen.append(s)
        out[d] = ("\n".join(kept) if t is not None else None, gone)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"wörd{i}" for i in range(60)] + ["The", "of", "a"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 9, 12, 30]))] for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(0, 9)):
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((d, "\n".join(lines)))
    rows += [(100, ""), (101, None), (102, "\n \n"), (103, rows[2][1]), (104, rows[2][1].upper())]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(df).collect()}
    assert got == brute(rows)


def test_empty_table_null_and_repeated_ids(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c d\na b c d", None, None), (1, "a b c d e", "x", 1), (1, "a b c d e", "x", 1), (-3, "a b c d f e", "x", 1)], SCHEMA)
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in line_dedup(df).collect())
    assert got == [(-3, "a b c d f e", 1, 0), (0, "a b c d\na b c d", 2, 0), (1, "", 1, 1), (1, "", 1, 1)]


def test_any_doc_id_and_number_of_lines(spark):
    blank, same = "\n" * ((1 << 22) + 2), "x\n" * 200_000
    rows = [(2**62, "a b c d e"), (-(2**63), "a b c d f e"), (2**63 - 1, "new\na b c d e"), (1 << 40, f"one{blank}two\none"), ((1 << 40) + 1, same), (5, "two")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(df).collect()}
    assert got.pop(1 << 40) == (f"one{blank}"[:-1], (1 << 22) + 4, 2)
    assert got.pop((1 << 40) + 1) == ("x\n", 200_001, 199_999)
    assert got == {2**62: ("", 1, 1), -(2**63): ("a b c d f e", 1, 0), 2**63 - 1: ("new", 2, 1), 5: ("two", 1, 0)}


def test_lines_of_white_space_stay(spark):
    text = "a b c\r\n\r\n\t\n\r\n \t\n\t\n\x0b\n\x0b\nA b c"
    df = spark.createDataFrame([(1, text, "x", 1), (2, "\r\n\t", "x", 1)], SCHEMA)
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup(df).collect()} == {1: (text[: -len("\nA b c")], 1), 2: ("\r\n\t", 0)}


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x", 1)], SCHEMA)
    plan = line_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None


def test_helper_names_among_the_columns(spark):
    names = ["_doc", "doc", "gone", "_gone", "parts", "word", "mask", "k"]
    df = spark.createDataFrame([(1, "a b c\nx", *names), (2, "a b c", *names)], ["doc_id", "text", *names])
    got = line_dedup(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_removed, r.gone) for r in got.collect()) == [(1, "a b c\nx", 0, "gone"), (2, "", 1, "gone")]


def test_driver_holds_a_small_plan_and_few_bitmap_rows(spark):
    """The rarity table stands in the plan of the prefix rows: its text, of which Spark keeps several copies, stays small; a full bitmap has few rows."""
    from voxelspark.llm import common, line_dedup as L

    lines = L._lines(spark.createDataFrame([(1, "a b c d e\nf g h")], "doc_id long, text string"))
    assert len(L._index(lines, L._rank_table(lines))._jdf.queryExecution().executedPlan().toString()) < 1_000_000
    keys = spark.range(200_000)
    assert common.hit_words(keys, F.col("id")).count() <= 1 << 15
    some = spark.range(0, 400_000, 3)
    words = common.hit_words(keys, F.col("id"))
    inside, outside = (common.may_hit(some, words, F.col("id"), outside=o) for o in (False, True))
    assert outside.where("id < 200000").count() == 0 and inside.count() + outside.count() == some.count() and outside.count() > 60_000


def test_parity_of_long_and_short_lines(spark):
    """Pairs at the limit on both sides of the length from which the parity has 128 bits."""
    from voxelspark.llm.line_dedup import LONG

    rows = []
    for i, n in enumerate([LONG - 12, LONG - 2, LONG, LONG + 1, LONG + 8, 3 * LONG]):
        w = [f"t{i}_{k}" for k in range(n)]
        most = n - -(-4 * n // 5)
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w[most:])), (10 * i + 2, " ".join(w[: n - most - 1])), (10 * i + 3, " ".join(w[: -(n // 9)] + [f"u{i}_{k}" for k in range(n // 9)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup(df).collect()} == brute(rows)

"""Line dedup: exact set-similarity join of lines (DataFrame operations only).

A line is the set of its lower-cased tokens. A line is removed if an earlier
line (smaller doc_id, or the same doc_id and an earlier line) has a Jaccard
similarity of 0.8 or more; lines are judged on the input. Equal lines are found
by grouping. The others go through a prefix join: tokens are ordered by rarity
(counts of hashed tokens, a table of fixed size), and two similar lines share a
token among the first n - ceil(0.8 n) + 1. Length and positional filters and the
parity of 64 token bits, 128 for long lines (at most the size of the symmetric
difference), drop pairs that can't reach 0.8.

The prefix rows are shuffled once, by token. A semi-join within that shuffle
keeps the rows that have any partner left after the filters, never the pairs.
These few rows are then paired: each line first with the earliest line of its
tokens, so that a large group of near copies is settled by a star of pairs, and
only undecided lines with the other earlier lines. Pairs are verified on the
token sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, fresh, hit_words, may_hit, read, table

RANKS = 1 << 16
#: Lines of more tokens have a parity of 128 bits, the others one of 64.
LONG = 96


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, no, raw) of documents with an id, without lines that have no tokens."""
    rows = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "raw"))
    return rows.where(F.ltrim("raw", F.lit(" \t\r\x0b\x0c")) != "")


def _plain() -> Column:
    """A line in lower case with blanks for all white space."""
    low = F.lower("raw")
    other = [F.contains(low, F.lit(c)) for c in "\t\r\x0b\x0c"]
    return F.when(other[0] | other[1] | other[2] | other[3], F.translate(low, "\t\r\x0b\x0c", "    ")).otherwise(low)


def _place(side: str = "") -> Column:
    return F.struct(F.col(f"{side}doc_id").alias("doc_id"), F.col(f"{side}no").alias("no"))


def _rank_table(lines: DataFrame) -> Column:
    """Rarity of hashed tokens as an array literal of RANKS bytes: quarter steps of the logarithm of their counts.

    Counts (of tokens as they are written) are summed by Spark; the driver
    gets RANKS rows at most.
    """
    tokens = lines.select(F.explode(F.split("raw", " ")).alias("t")).where("t <> ''")
    counts = tokens.groupBy(_bucket(F.xxhash64("t")).alias("b")).count()
    rows = counts.select("b", F.floor(F.ln(F.col("count") + 1) * 4).cast("int").alias("v")).toArrow()
    rank = np.zeros(RANKS, np.uint8)
    rank[rows["b"].to_numpy()] = np.minimum(rows["v"].to_numpy(), 127)
    return F.from_json(F.lit(str(rank.tolist())), "array<tinyint>")  # folded once, when the plan is optimised


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(RANKS - 1)).cast("int")


def _code(h: Column, rank: Column) -> Column:
    """The hash of a token as a long that sorts by rarity: its rank, then 56 bits of the hash."""
    return F.call_function("shiftleft", F.get(rank, _bucket(h)).cast("bigint"), F.lit(56)).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))


def _bit(t: Column) -> Column:
    return t.bitwiseAND(F.lit(63)).cast("int")


def _parity() -> Column:
    """Parity of the codes s in 64 bits."""
    return F.aggregate("s", F.lit(0).cast("bigint"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(t))))


def _half() -> Column:
    """Parity of the codes with bit 6 set: with _parity() it makes 128 bits."""
    return F.aggregate("s", F.lit(0).cast("bigint"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.shiftright(t, 6).bitwiseAND(F.lit(1)), _bit(t))))


def _index(lines: DataFrame, rank: Column) -> DataFrame:
    """Prefix rows (token, doc_id, no, n, i, lo, hi) of each line."""
    # ranks and parity are worked out for the distinct hashes only
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("low", " "), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))
    # explode of one element: what stands below and above it is not merged into it, so each line is worked out once
    rows = lines.select("doc_id", "no", _plain().alias("low"))
    rows = rows.select("doc_id", "no", F.explode(F.array(F.sort_array(F.transform(hashes, lambda h: _code(h, rank))))).alias("s"))
    n = F.size("s")
    prefix = F.slice("s", F.lit(1), n - F.expr("(4 * size(s) + 4) div 5").cast("int") + 1)
    half = F.when(n > LONG, _half()).otherwise(0)
    rows = rows.select("doc_id", "no", F.explode(F.array(F.struct(n.alias("n"), _parity().alias("lo"), half.alias("hi"), prefix.alias("prefix")))).alias("x"))
    return rows.select("doc_id", "no", "x.n", "x.lo", "x.hi", F.posexplode("x.prefix").alias("i", "token"))


_FITS = f"""9 * bit_count(a.lo ^ b.lo) <= a.n + b.n
    and 9 * least(a.n - a.i, b.n - b.i) >= 4 * (a.n + b.n)
    and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n
    and (a.n <= {LONG} or b.n <= {LONG} or 9 * (bit_count(a.lo ^ a.hi ^ b.lo ^ b.hi) + bit_count(a.hi ^ b.hi)) <= a.n + b.n)"""
_APART = "(a.doc_id <> b.doc_id or a.no <> b.no)"
_LATER = "(b.doc_id < a.doc_id or b.doc_id = a.doc_id and b.no < a.no)"


def _pairs(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pairs of places (a, b), b the earlier, that share a token and pass the filters."""
    return later.alias("a").join(earlier.alias("b"), F.expr(f"a.token = b.token and {_FITS} and {_LATER}")).select(_place("a.").alias("a"), _place("b.").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Places a of pairs (a, b) whose token sets, any of those at a place, have a Jaccard similarity of 0.8 or more."""
    full = pairs.join(sets.select(F.col("place").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("place").alias("b"), F.col("s").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    return full.where(5 * same >= 4 * (F.size("x") + F.size("y") - same)).select(F.col("a").alias("place")).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """Lines to remove: rows (doc_id, no)."""
    lines = _lines(documents(docs))
    key = [F.xxhash64("raw").alias("k"), F.hash("raw").alias("k2")]
    repeated = table(lines.select(*key).groupBy("k", "k2").count().where("count > 1").select("k"))
    words = hit_words(repeated, F.col("k"))
    # of equal lines only the first enters the index; lines that surely stand alone are not shuffled for that
    some = may_hit(lines.select("doc_id", "no", "raw", *key), words, F.col("k"))
    firsts = table(some.groupBy("k", "k2").agg(F.min(F.struct("doc_id", "no", "raw")).alias("f")).select("k", "k2", "f.*"))
    equal = some.select("k", "k2", _place().alias("place")).join(firsts.select("k", "k2", _place().alias("first")), ["k", "k2"]).where("place > first").select("place")
    single = may_hit(lines, words, F.xxhash64("raw"), outside=True).unionByName(firsts.select("doc_id", "no", "raw"))
    index = _index(single, _rank_table(single))
    # both sides are one exchange: they have the same plan and the same columns
    hits = table(index.alias("a").join(index.alias("b"), F.expr(f"a.token = b.token and {_FITS} and {_APART}"), "left_semi"))
    wanted = may_hit(lines, hit_words(hits, _place()), _place()).select(_place().alias("place"), _plain().alias("low"))
    wanted = wanted.select("place", F.explode(F.array(F.transform(F.array_remove(F.split("low", " "), ""), lambda t: F.xxhash64(t)))).alias("s"))
    sets = table(wanted.select("place", F.sort_array(F.array_distinct("s")).alias("s")).distinct())
    low = hits.groupBy("token").agg(F.min(F.struct("doc_id", "no", "n", "i", "lo", "hi")).alias("low")).select("token", "low.*")
    star = table(_pairs(hits, low))
    settled = table(_verified(star, sets))
    undecided = hits.join(settled.select("place.doc_id", "place.no"), ["doc_id", "no"], "left_anti")
    rest = _pairs(undecided, hits).join(star, ["a", "b"], "left_anti")
    near = table(settled.unionByName(_verified(rest, sets)))
    discard(hits, sets, star, settled)
    gone = table(equal.unionByName(near).distinct().select("place.doc_id", "place.no"))
    discard(repeated, firsts, near)
    return gone


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with later matches taken out of text, and n_lines and n_removed added.

    Lines end at line feeds; a line without tokens is never removed. A null
    text stays null, an empty one is one empty line. Rows with a null doc_id
    are not compared. Rows that repeat a doc_id count as that document: they do
    not remove each other's lines at the same place. Texts of any length are
    taken whole. All columns are kept; n_lines and n_removed must not be among
    them.
    """
    if clash := {"n_lines", "n_removed"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns that line dedup adds: {sorted(clash)}")
    doc, gone, parts = fresh(docs, "doc", "gone", "parts")
    removed = removed_lines(docs)
    by_doc = removed.groupBy("doc_id").agg(F.collect_set("no").alias(gone)).withColumnRenamed("doc_id", doc)
    key, words = F.col("doc_id").cast("bigint"), hit_words(removed, F.col("doc_id"))
    # only documents that may lose lines are shuffled
    whole = may_hit(docs, words, key, outside=True).withColumns({"n_lines": F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)), "n_removed": F.lit(0)})
    some = may_hit(docs, words, key).join(by_doc, key == F.col(doc), "left").drop(doc)
    # split once, before the lines are looked up by number: the work is linear in the lines
    some = some.withColumn(parts, F.explode(F.array(F.split("text", "\n", -1))))
    numbers = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    kept = F.array_join(F.transform(numbers, lambda i: F.get(parts, i)), "\n")
    some = some.withColumns({"n_lines": F.coalesce(F.size(parts), F.lit(0)), "n_removed": F.coalesce(F.size(gone), F.lit(0))})
    some = some.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).drop(gone, parts)
    return whole.unionByName(some)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))

"""Hard-negative mining: cover trees over norm-augmented vectors.

A vector x gets one more component, sqrt(M^2 - |x|^2), so that all of a tree
lie on a sphere of radius M. A node stands for the points within its covering
radius of its centre; each level covers with a smaller radius, the factor is
BASE. For a query q (whose further component is 0) the angle to a centre and
the covering radius, as an angle, bound the inner products of all points below
a node from both sides. A search goes down level by level, drops the nodes
whose bounds lie outside a query's window or below its k-th score so far, and
then takes the leaves of each query in order of their upper bounds: the best
one first, then twice as many in each round. Points of leaves are scored
exactly.

Rows are dealt to trees of about TREE points by label (a large label by hash
too). Queries are dealt to blocks; a task holds one block of queries and
streams the trees of one group, so neither side has to fit anywhere as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, table

TREE, LEAF, BASE, BLOCK, GROUP = 4096, 32, 1.3, 2048, 4
_LABELS = 1024  # buckets of labels
_INF = float("inf")


def augment(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors with the component that brings them to the norm of the longest, and that norm."""
    squares = (x * x).sum(1)
    top = float(squares.max(initial=0.0))
    return np.concatenate([x, np.sqrt(np.maximum(top - squares, 0))[:, None]], axis=1), math.sqrt(top)


def build(x: np.ndarray, leaf: int = LEAF, base: float = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points and the nodes of their cover tree, levels one behind the other.

    Nodes are rows (centre, parent, level, first, end, radius): a node covers
    the points first..end in that order, within radius of the point centre. A
    node of at most `leaf` points, or of equal points, has no children.
    """
    x, _ = augment(x)
    order = np.arange(len(x))
    far = np.sqrt(((x - x[0]) ** 2).sum(1))
    nodes, at, level = [(0, -1, 0, 0, len(x), far.max())], 0, 0
    limit = far.max()
    while at < len(nodes):
        end, level, limit = len(nodes), level + 1, limit / base
        for k in range(at, end):
            centre, _, _, lo, hi, radius = nodes[k]
            if hi - lo <= leaf or radius == 0:
                continue
            own = order[lo:hi]
            points, nearest = x[own], np.zeros(hi - lo, int)
            centres, gap = [centre], np.sqrt(((x[own] - x[centre]) ** 2).sum(1))
            while gap.max() > min(limit, radius / base):
                centres.append(own[gap.argmax()])
                to = np.sqrt(((points - x[centres[-1]]) ** 2).sum(1))
                closer = to < gap
                nearest[closer], gap[closer] = len(centres) - 1, to[closer]
            moved = np.argsort(nearest, kind="stable")
            order[lo:hi], gap = own[moved], gap[moved]
            cuts = np.searchsorted(nearest[moved], np.arange(len(centres) + 1))
            for c, a, b in zip(centres, cuts[:-1], cuts[1:]):
                if b > a:
                    nodes.append((c, k, level, lo + a, lo + b, gap[a:b].max()))
        at = end
    return order, np.array(nodes, float)


def bounds(scores: np.ndarray, radius: np.ndarray, norms: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query (rows) with any point of each node (columns)."""
    size = norms[:, None] * top
    angle = np.arccos(np.clip(scores / np.maximum(size, 1e-300), -1, 1))
    around = 2 * np.arcsin(np.clip(radius / max(2 * top, 1e-300), 0, 1))
    slack = 1e-6 * size + 1e-6
    return size * np.cos(np.minimum(angle + around, np.pi)) - slack, size * np.cos(np.maximum(angle - around, 0)) + slack


class Best:
    """The k best (score, id) so far of each query, ties by smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.floor = k, np.full(n, -_INF)
        self.query, self.score, self.id = (np.zeros(0, t) for t in (np.int64, float, np.int64))

    def add(self, query: list[np.ndarray], score: list[np.ndarray], ids: list[np.ndarray]) -> None:
        q, s, i = (np.concatenate([a, *b]) for a, b in ((self.query, query), (self.score, score), (self.id, ids)))
        by = np.lexsort((i, -s, q))
        q, s, i = q[by], s[by], i[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[q[last]] = s[last]
        self.query, self.score, self.id = q[keep], s[keep], i[keep]


def search(tree: dict, q: dict, best: Best) -> int:
    """Offer a tree's points to best; returns how many (query, point) pairs were scored.

    tree: x, ids, labels, keys (in the order of its nodes), nodes. q: x, label,
    key, lo, hi, same: a point is for a query if its score lies in lo..hi, its
    key is another, and its label is the query's (same) or another (not same).
    """
    x, nodes = tree["x"], tree["nodes"]
    top = math.sqrt(float((x * x).sum(1).max(initial=0.0)))
    norms = np.sqrt((q["x"] ** 2).sum(1))
    parent, level = nodes[:, 1].astype(int), nodes[:, 2].astype(int)
    inner = np.zeros(len(nodes), bool)
    inner[parent[1:]] = True
    labels = tree["labels"]
    pure = labels[0] if (labels == labels[0]).all() else None
    alive = np.zeros((len(q["x"]), len(nodes)), bool)
    upper = np.full(alive.shape, -_INF)
    fits = np.ones(len(q["x"]), bool) if pure is None else (q["label"] == pure) == q["same"]
    for deep in range(level.max() + 1):
        here = np.flatnonzero(level == deep)
        open_ = fits[:, None] & np.ones(len(here), bool) if deep == 0 else alive[:, parent[here]]
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            break
        scores = q["x"][rows] @ tree["centres"][here].T
        least, most = bounds(scores, nodes[here, 5], norms[rows], top)
        inside = open_[rows] & (most >= np.maximum(q["lo"], best.floor)[rows, None]) & (least <= q["hi"][rows, None])
        alive[np.ix_(rows, here)], upper[np.ix_(rows, here)] = inside, most
    leaves = np.flatnonzero(~inner)
    upper = np.where(alive[:, leaves], upper[:, leaves], -_INF)
    turn = np.argsort(-upper, axis=1, kind="stable")
    scored = first = 0
    count = 1
    while first < len(leaves):
        some = turn[:, first : first + count]
        ahead = np.take_along_axis(upper, some, 1)
        ahead = (ahead > -_INF) & (ahead >= np.maximum(q["lo"], best.floor)[:, None])
        if not ahead.any():
            break
        rows, which = np.nonzero(ahead)
        which = some[rows, which]
        by = np.argsort(which, kind="stable")
        cuts = np.flatnonzero(np.diff(which[by], prepend=-1, append=-1))
        found: tuple[list, list, list] = ([], [], [])
        for a, b in zip(cuts[:-1], cuts[1:]):
            r, (lo, hi) = rows[by[a:b]], nodes[leaves[which[by[a]]], 3:5].astype(int)
            s = q["x"][r] @ x[lo:hi].T
            scored += s.size
            good = (s >= np.maximum(q["lo"], best.floor)[r, None]) & (s <= q["hi"][r, None]) & ((labels[lo:hi] == q["label"][r, None]) == q["same"]) & (tree["keys"][lo:hi] != q["key"][r, None])
            i, j = np.nonzero(good)
            for to, what in zip(found, (r[i], s[i, j], tree["ids"][lo:hi][j])):
                to.append(what)
        best.add(*found)
        first, count = first + count, count * 2
    return scored


# tables


def prepare(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, x (whole numbers) and a row key; rows that take no part are left out, equal rows are one."""
    whole = F.transform("embedding", lambda v: F.floor(256 * v.cast("double")).cast("double"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("embedding", lambda v: F.abs(v) < _INF), F.lit(False))
    rows = embeddings.where(fit).select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), whole.alias("x"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), "x", F.size("x").alias("dim"), F.xxhash64("vec_id", label, "x").alias("key")).dropDuplicates(["vec_id", "label", "x"])


_TREES = "dim int, tree long, points binary, ids array<long>, labels array<long>, keys array<long>, nodes binary"


def _grow(group: pa.Table) -> pa.Table:
    n, dim = group.num_rows, group.column("dim")[0].as_py()
    x = group.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
    order, nodes = build(x)
    lists = [pa.array([group.column(c).to_numpy()[order]], pa.list_(pa.int64())) for c in ("vec_id", "label", "key")]
    nodes[:, 0] = np.argsort(order)[nodes[:, 0].astype(int)]
    return pa.table([pa.array([dim], pa.int32()), group.column("tree").slice(0, 1), pa.array([x[order].astype("<f8").tobytes()]), *lists, pa.array([nodes.astype("<f8").tobytes()])], names=["dim", "tree", "points", "ids", "labels", "keys", "nodes"])


def grow(rows: DataFrame, size: int = TREE) -> DataFrame:
    """A cover tree of each label, of each part of a large label: about `size` points, whatever the label's share.

    What reaches the driver's broadcast is a count for each of 1,024 buckets
    of labels and each vector length.
    """
    bucket = F.pmod(F.xxhash64("label"), F.lit(_LABELS))
    rows = rows.withColumn("bucket", bucket)
    parts = rows.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / size).alias("parts"))
    tree = F.xxhash64("bucket", F.pmod(F.col("key"), F.col("parts")))
    dealt = rows.join(F.broadcast(parts), ["dim", "bucket"]).select("dim", tree.alias("tree"), "vec_id", "label", "key", "x")
    return table(dealt.groupBy("dim", "tree").applyInArrow(_grow, _TREES))


def _load(batch: pa.RecordBatch, i: int) -> dict:
    dim = batch.column("dim")[i].as_py()
    tree = {k: batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in ("ids", "labels", "keys")}
    tree["x"] = np.frombuffer(batch.column("points")[i].as_py()).reshape(len(tree["ids"]), dim)
    tree["nodes"] = np.frombuffer(batch.column("nodes")[i].as_py()).reshape(-1, 6)
    tree["centres"] = tree["x"][tree["nodes"][:, 0].astype(int)]
    return tree


def _search(k: int, same: bool):
    names = ["query", "score", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, q, best = None, [], {}, None

        def result() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.query):
                yield pa.RecordBatch.from_arrays([pa.array(q["query"][best.query]), pa.array(best.score.astype(np.int64)), pa.array(best.id)], names)

        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "g", "h"))))
            is_tree = batch.column("points").is_valid().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if where[i] != cell:
                    yield from result()
                    cell, rows, best = where[i], [], None
                if not is_tree[i]:
                    rows.append(tuple(batch.column(c)[i].as_py() for c in ("query", "key", "label", "lo", "hi", "x")))
                    continue
                if not rows:
                    continue
                if best is None:
                    q = {n: np.array(v, t) for n, v, t in zip(("query", "key", "label", "lo", "hi", "x"), zip(*rows), (np.int64, np.int64, np.int64, float, float, float))}
                    q["same"], best = same, Best(len(rows), k)
                search(_load(batch, i), q, best)
        yield from result()

    return run


def nearest(queries: DataFrame, trees: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best points of each query: rows (query, score, id), ties by smaller id.

    queries: query (a unique number), key, label, dim, x, lo, hi.
    """
    groups = max(1, math.ceil(trees.count() / GROUP))
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    tree_columns, query_columns = ("points", "ids", "labels", "keys", "nodes"), ("query", "key", "label", "lo", "hi", "x")
    of = {f.name: f.dataType for f in [*trees.schema, *queries.schema]}

    def columns(df: DataFrame, own: tuple, g: Column, h: Column) -> DataFrame:
        return df.select("dim", g.alias("g"), h.alias("h"), *[(F.col(c) if c in own else F.lit(None).cast(of[c])).alias(c) for c in tree_columns + query_columns])

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_g", each(groups))
    right = trees.withColumn("_h", each(blocks))
    union = columns(left, query_columns, F.col("_g"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).unionByName(columns(right, tree_columns, F.pmod(F.col("tree"), F.lit(groups)).cast("int"), F.col("_h")))
    cells = union.repartition(groups * blocks, "dim", "g", "h").sortWithinPartitions("dim", "g", "h", F.col("points").isNotNull())
    rows = cells.mapInArrow(_search(k, same), "query long, score long, id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Per anchor (vec_id divisible by `every`) and positive: the first rows of other labels whose score lies in low..high per cent of the positive's.

    Scores are inner products of floor(256 x), exact below 2^53. Rows with a
    null vec_id, label, vector or component, or a component that is not
    finite, take no part. Equal rows are one row; other rows of one vec_id
    are rows of their own. Only vectors of the same length are compared. Other
    columns are not used. An empty table gives no rows. A window whose
    positive has a negative score is empty.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = table(prepare(embeddings))
    trees = grow(rows)
    anchors = rows.where(F.col("vec_id") % every == 0)
    asked = anchors.select(F.col("key").alias("query"), "key", "label", "dim", "x", F.lit(-_INF).alias("lo"), F.lit(_INF).alias("hi"))
    first = table(nearest(asked, trees, positives, True))
    pairs = anchors.join(first.withColumnRenamed("query", "key"), "key").withColumnRenamed("vec_id", "anchor_id")
    pairs = table(pairs.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "key", "label", "dim", "x", F.xxhash64("key", "rank").alias("query")))
    # whole numbers between low * positive and high * positive, both per cent
    lo, hi = F.expr(f"(positive_score * {low}L + 99L) div 100"), F.expr(f"(positive_score * {high}L) div 100")
    windows = pairs.where("positive_score >= 0").withColumns({"lo": lo.cast("double"), "hi": hi.cast("double")})
    out = nearest(windows.select("query", "key", "label", "dim", "x", "lo", "hi"), trees, negatives, False)
    out = out.join(pairs.select("query", "anchor_id", "positive_id", "positive_score"), "query")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * v::DOUBLE) for v in embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"))

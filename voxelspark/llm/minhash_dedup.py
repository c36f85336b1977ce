"""MinHash near-dedup: chosen-path set similarity join over word shingles.

Documents with equal shingle sets form a class, named by the hash of its set;
one text stands for it. Independent trees branch the classes: at each step a node chooses places of
the MinHash signature by the hash of its own path, and a class goes to the
child of its value at that place. Nodes over `leaf` classes branch on. Nodes are
streamed through tasks, where all classes of one are compared by a 4-bit sketch;
those within its slack of the limit, and what they chain to, form a family. Each family is then compared
exhaustively on the full shingle sets of its texts. Both steps return a
spanning forest of the links found, never all pairs, and cut large groups into
pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, components, documents, in_bitmap, read, table
from .words import lower_ascii, mix, ngram_hashes, text_slices, word_hashes

_U = np.uint64
SIGNATURE = 64
_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, s array<long>, mins array<int>"


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle, none an empty set."""
    h, _, first = word_hashes(lower_ascii(raw), off)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(ngram_hashes(h[a:b], k)))
        elif b > a:
            out.append(ngram_hashes(h[a:b], b - a) ^ _U(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each set, in two halves; 0 for an empty one."""
    size = np.array([len(s) for s in sets])
    flat, full = np.concatenate(sets), np.flatnonzero(size)
    h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if len(flat):
        begin = np.concatenate(([0], np.cumsum(size)))[:-1][full]
        h1[full] = np.add.reduceat(mix(flat), begin)
        h2[full] = np.bitwise_xor.reduceat(mix(flat ^ _U(0x5851F42D4C957F2D)), begin)
    return h1, h2


def _texts(k: int, bits):
    """mapInArrow function: set hash and text of the documents whose set may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in text_slices(batch.column("text")):
                h1, h2 = set_hashes(shingle_sets(raw, off, k))
                own = in_bitmap(bits.value, h1)
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array(h1[own].view(np.int64)), pa.array(h2[own].view(np.int64)), batch.column("text").slice(i, j - i).filter(pa.array(own))], ["h1", "h2", "text"])

    return run


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def _signatures(k: int, keys: tuple[str, ...] = ()):
    """mapInArrow function: size, 128-bit set hash, sketch and MinHash signature of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _multipliers()
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, raw, off in text_slices(batch.column("text")):
                sets = shingle_sets(raw, off, k)
                size = np.array([len(s) for s in sets])
                flat = np.concatenate(sets)
                full = np.flatnonzero(size)
                begin = np.concatenate(([0], np.cumsum(size)))[:-1][full]
                mins = np.zeros((len(sets), SIGNATURE), np.uint64)
                h1, h2 = set_hashes(sets)
                if len(flat):
                    for m in range(SIGNATURE):
                        x = flat * a[m]
                        mins[full, m] = np.minimum.reduceat(x ^ (x >> _U(32)), begin)
                mins = mix(mins)
                nibbles = (mins & _U(15)).reshape(len(sets), 4, 16)
                sketch = (nibbles << (np.arange(16, dtype=np.uint64) * _U(4))).sum(axis=2, dtype=np.uint64)
                small = (mins >> _U(32)).astype(np.uint32).view(np.int32)
                rows = np.arange(len(sets) + 1)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(pa.array((rows * 4).astype(np.int32)), pa.array(sketch.view(np.int64).ravel())), pa.ListArray.from_arrays(pa.array((rows * SIGNATURE).astype(np.int32)), pa.array(small.ravel())), *[batch.column(c).slice(i, j - i) for c in keys]],
                    ["doc_id", "n_shingles", "h1", "h2", "s", "mins", *keys],
                )

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by keys as tables of whole groups, with the first row of each group and an end mark."""
    rest: list[pa.RecordBatch] = []

    def heads(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*rest, batch])
        h = heads(t)
        if len(h) > 1:
            yield t.slice(0, h[-1]), h
        rest = t.slice(h[-1]).to_batches()
    if rest:
        t = pa.Table.from_batches(rest)
        yield t, np.append(heads(t), t.num_rows)


def forest(family: np.ndarray, near) -> list[tuple[int, int]]:
    """Links that join families; near(i, others) tells which of others are linked with i. Members of a family count as linked."""
    left, out = np.arange(len(family)), []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            own = family[left] == family[i]
            hit = near(i, left)
            other = left[hit & ~own]
            out += [(i, int(other[k])) for k in np.unique(family[other], return_index=True)[1]]
            reached += left[hit | own].tolist()
            left = left[~(hit | own)]
    return out


_NIBBLES = _U(0x1111111111111111)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of the 64 sketch nibbles that differ, row by row."""
    d = x ^ y
    d |= d >> _U(1)
    d |= d >> _U(2)
    return np.bitwise_count(d & _NIBBLES).sum(axis=1)


def _alike(slack: int):
    """mapInArrow function over sorted (node, i, j, rep, family, s0..s3): sketch links that join the families of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, heads in whole_groups(batches, ["node", "i", "j"]):
            rep, family = t.column("rep").to_numpy(), t.column("family").to_numpy()
            s = np.stack([t.column(f"s{k}").to_numpy() for k in range(4)], axis=1).view(np.uint64)
            size = np.diff(heads)
            pairs = []
            of = np.repeat(np.where(size <= 3, np.arange(len(size)), -1), size)
            for lag in range(1, min(3, int(size.max()))):
                x = np.flatnonzero((of[lag:] == of[:-lag]) & (of[lag:] >= 0))
                x = x[(family[x] != family[x + lag]) & (_apart(s[x], s[x + lag]) <= slack)]
                pairs.append(np.stack([rep[x], rep[x + lag]], axis=1))
            for g in np.flatnonzero(size > 3).tolist():
                own, ids, kin = s[heads[g] : heads[g + 1]], rep[heads[g] : heads[g + 1]], family[heads[g] : heads[g + 1]]
                if (kin == kin[0]).all():
                    continue
                found = forest(kin, lambda i, o: _apart(own[o], own[i : i + 1]) <= slack)  # noqa: B023
                pairs.append(ids[np.array(found, np.int64).reshape(-1, 2)])
            if pairs and len(p := np.concatenate(pairs)):
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    return run


def _exact(k: int, num: int, den: int):
    """mapInArrow function over sorted (family, i, j, rep, text): forest of the pairs with den * |A & B| >= num * |A | B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, heads in whole_groups(batches, ["family", "i", "j"]):
            rep, text = t.column("rep").to_numpy(), t.column("text")
            out: list[np.ndarray] = []
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
                sets = []
                for _, _, raw, off in text_slices(text.slice(a, b - a)):
                    sets += shingle_sets(raw, off, k)
                size = np.array([len(x) for x in sets])
                common = _intersections(sets)
                linked = den * common >= num * (size[:, None] + size[None, :] - common)
                found = forest(np.arange(len(sets)), lambda i, o: linked[i, o])  # noqa: B023
                out.append(rep[a:b][np.array(found, np.int64).reshape(-1, 2)])
            if len(p := np.concatenate(out)):
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    return run


def _intersections(sets: list[np.ndarray], cells: int = 4_000_000) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices over the shingles that two sets or more have."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    row, column = row[shared], number[column[shared]]
    out = np.zeros((n, n), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, cells // n)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        x = np.zeros((n, min(width, int(column[-1]) + 1 - lo)), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    return out


def _in_blocks(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows of a group in pairs of blocks (i, j): any two rows of the group meet in one. Small groups stay as (0, 0)."""
    df = df.withColumn("_n", blocks.cast("int")).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    df = df.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}).drop("_n", "_own", "_other")
    return df.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _child(node: Column, branch: int) -> Column:
    place = F.pmod(F.xxhash64(node, F.lit(branch)), F.lit(SIGNATURE)).cast("int")
    return F.xxhash64(node, place, F.element_at("mins", place + 1))


def _nodes(known: DataFrame, trees: list[int], branches: tuple[int, ...], leaf: int, deeper: int) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """Rows (node, rep, family, s) of the trees, each time with the sizes (node, m) of the nodes that are larger than leaf, None where there are none.

    Rows of larger nodes branch on, `deeper` times at most; a node of near
    copies stays together at any depth.
    """
    rows = known.select("rep", "family", "s", "mins", F.explode(F.array(*map(F.lit, trees))).alias("tree")).withColumn("node", F.xxhash64("tree")).drop("tree")
    for width in branches:
        rows = rows.withColumn("node", F.explode(F.array(*[_child(F.col("node"), b) for b in range(width)])))
    for depth in range(deeper + 1):
        # a large node of one family has nothing to add: it counts as small, and its task skips it
        large = table(rows.groupBy("node").agg(F.count("*").alias("m"), F.min("family").alias("lo"), F.max("family").alias("hi")).where((F.col("m") > leaf) & (F.col("lo") < F.col("hi"))).select("node", "m"))
        flat = ["node", "rep", "family", "s"]
        if large.isEmpty():
            yield rows.select(*flat), None
            return
        yield rows.join(large, "node", "left_anti").select(*flat), None
        if depth == deeper:
            yield rows.join(large, "node").select(*flat, "m"), large
            return
        on = rows.join(large, "node", "left_semi").withColumn("node", F.explode(F.array(*[_child(F.col("node"), b) for b in range(2)])))
        rows = table(on.select(*flat, "mins").dropDuplicates(["node", "rep"]))


def _sketch_links(known: DataFrame, slack: int, trees: list[int], branches: tuple[int, ...], leaf: int, deeper: int, block: int) -> DataFrame:
    """Pairs of classes in a node whose sketches differ in slack places at most: for each node a forest that joins its families."""
    flat = [F.col("s")[i].alias(f"s{i}") for i in range(4)]
    out = None
    for rows, large in _nodes(known, trees, branches, leaf, deeper):
        if large is None:
            groups = rows.select("node", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", "family", *flat).repartition("node").sortWithinPartitions("node")
        else:
            groups = _in_blocks(rows.select("node", "rep", "family", "m", *flat), "node", F.ceil(F.col("m") / block)).select("node", "i", "j", "rep", "family", "s0", "s1", "s2", "s3")
        links = groups.mapInArrow(_alike(slack), "a long, b long")
        out = links if out is None else out.unionByName(links)
    return table(out)


def near_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, trees: int = 8, branches: tuple[int, ...] = (2, 1, 1), leaf: int = 256, deeper: int = 3, block: int = 1024, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if den * |A & B| >= num * |A | B| for their sets
    of k-word shingles (lower-cased A-Z); component_id is the smallest doc_id
    that links reach. Empty and null texts have no shingles and no links. A
    null doc_id gives component_id null and kept true. Rows that repeat a
    doc_id and its text get the same result each. A doc_id on several texts is
    the name of the group of each, so unlike groups can have one
    component_id. Texts of any length are taken whole. Other columns are
    ignored, but for the bigint columns named by keys, which are carried.

    A pair at the limit is in one node of a tree with probability about
    1 - (1 - s**3)**2 (s the similarity); over eight trees a pair at
    0.8 is missed about once in 100,000, at 0.85 once in four millions. In nodes
    that branch on, each level keeps a pair with 1 - (1 - s * q)**2, q being what
    the next keeps: with all three, 2.7 of 100,000 at 0.8 and one of two millions
    at 0.85 (by this model, with independent paths; tests measure the recall
    against all pairs). The sketch slack is 4.5 deviations: 3 of a million
    pairs at the limit are beyond it. A group of more than `block` classes
    takes a task for each pair of blocks.
    """
    docs = documents(docs, *keys)
    signed = table(docs.mapInArrow(_signatures(k, keys), "".join([_SIGNED, *[f", {c} long" for c in keys]])))
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("s").alias("s"), F.first("mins").alias("mins"))
    classes = table(classes.withColumn("rep", F.xxhash64("h1", "h2")))
    differ = (1 - num / den) * 15 / 16
    slack = int(SIGNATURE * differ + 4.5 * (SIGNATURE * differ * (1 - differ)) ** 0.5)
    # the families of the first trees are known to the others, which only add what joins them
    alike = _sketch_links(classes.withColumn("family", F.col("rep")), slack, list(range(min(2, trees))), branches, leaf, deeper, block)
    if trees > 2:
        known = classes.join(components(alike).withColumnRenamed("node", "rep"), "rep", "left").withColumn("family", F.coalesce("component", "rep")).drop("component")
        alike = alike.unionByName(_sketch_links(table(known), slack, list(range(2, trees)), branches, leaf, deeper, block))
    families = components(alike)
    families = table(families.select(F.col("node").alias("rep"), F.col("component").alias("family")).join(classes.select("rep", "n_shingles"), "rep"))
    sizes = families.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / (2000 * block))).alias("blocks"))
    # one text of each class, found by its set: a doc_id may have many rows and texts
    wanted = bitmap(families.join(classes.select("rep", "h1"), "rep"), F.col("h1"), 26)
    texts = docs.where("doc_id is not null").select("text").mapInArrow(_texts(k, wanted), "h1 long, h2 long, text string").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    texts = texts.select(F.xxhash64("h1", "h2").alias("rep"), "text").join(families.join(sizes, "family"), "rep")
    grouped = _in_blocks(texts, "family", F.col("blocks")).select("family", "i", "j", "rep", "text")
    found = table(components(grouped.mapInArrow(_exact(k, num, den), "a long, b long")))
    lowest = found.join(classes.select(F.col("rep").alias("node"), "low"), "node").groupBy("component").agg(F.min("low").alias("c"))
    named = classes.select("h1", "h2", "rep", "low").join(found.join(lowest, "component").select(F.col("node").alias("rep"), "c"), "rep", "left").select("h1", "h2", F.coalesce("c", "low").alias("c"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2", *keys).join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), *keys).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), k=3, num=85, den=100)

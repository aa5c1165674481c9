"""N-gram Jaccard join with a MinHash LSH forest.

Texts become sets of word shingles; texts with equal sets are one class, told apart by a 128-bit sum over the set. Each class has a label in
every tree of the forest: a sequence of MinHash values. Sorted labels are the prefix tries. A match starts at the full label and is
shortened value by value until the trees together reach the target recall at the threshold: the chance that two sets of similarity s share
a prefix of length d in one of t trees is 1 - (1 - s^d)^t, so the depth needed follows from the recall. Labels are sorted over the whole
cluster by range, neighbours compared in a stream, and subtrees that cross a border of partitions are joined through the border rows.

Classes that share subtrees form candidate groups. A group is verified exactly, in blocks of bounded size and pairs of blocks: shared
prefixes are looked up again, and the Jaccard similarity of every candidate pair is computed from the texts. A task gives one row for each
class and block pair (links found, and a root), never the pairs; so links between different texts are all counted while copies are never
expanded. Verified links are joined into groups of near copies.

A text of 1 to 4 words has one shingle, all its words. Null texts and texts without words have no shingle: they link to nothing, each is a
group of its own. Repeated rows are copies. The group id is the smallest id of the group; null ids don't count for it unless there is no
other. An empty table gives an empty result. Other columns are left out of the join, so their names can't clash.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .components import components, forest
from .words import flat, mix, powers, words_of

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
RECALL = 0.999
#: Classes verified together in one block.
BLOCK = 800
_RADIX = 0xD6E8FEB86659FD93
_SEEDS = 0x2545F4914F6CDD1D


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that still gives the recall; 1 at least."""
    d = depth
    while d > 1 and 1 - (1 - threshold ** d) ** trees < recall:
        d -= 1
    return d


def shingle_sets(words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text and sorted, and where each text's set begins and ends."""
    h, first = words.hashes, words.first
    n_texts, n = len(first) - 1, len(words.hashes)
    counts = np.diff(first)
    owner, value = [], []
    if n >= size:
        up = [np.uint64(x) for x in powers(_RADIX, size)]
        rolled = h[:n - size + 1] * up[0]
        for k in range(1, size):
            rolled = rolled + h[k:n - size + 1 + k] * up[k]
        text = np.repeat(np.arange(n_texts), counts)
        inside = text[:n - size + 1] == text[size - 1:]
        owner.append(text[:n - size + 1][inside])
        value.append(mix(rolled[inside]))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        up = powers(_RADIX | 2, size)
        owner.append(short)
        value.append(np.array([mix(np.array([np.sum(h[first[i]:first[i + 1]] * up[:counts[i]]) + np.uint64(counts[i])], np.uint64))[0] for i in short], np.uint64))
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    value = np.concatenate(value) if value else np.zeros(0, np.uint64)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(owner):
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(n_texts + 1))


def labels(value: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """(texts, trees * depth) MinHash values of 16 bits; texts must have shingles."""
    out = np.empty((len(first) - 1, trees * depth), ">u2")
    seeds = mix(np.arange(1, trees * depth + 1, dtype=np.uint64) * np.uint64(_SEEDS)) | np.uint64(1)
    for k, seed in enumerate(seeds):
        least = np.minimum.reduceat((value * seed) >> np.uint64(16), first[:-1])
        out[:, k] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def set_keys(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each text's set, its size mixed in."""
    size = np.diff(first).astype(np.uint64)
    total = []
    for seed in (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ seed))])
        total.append(mix(sums[first[1:]] - sums[first[:-1]] + size * seed).view(np.int64))
    return total[0], total[1]


def _signed(docs: DataFrame, doc_id: str, text: str, size: int, trees: int, depth: int) -> DataFrame:
    """id, row_key (a hash of id and text), k1, k2 (null without words) and the labels of all trees in one binary."""
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("row_key", F.xxhash64("id", "text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                value, first = shingle_sets(words_of(*flat(part["text"])), size)
                some = np.flatnonzero(np.diff(first) > 0)
                k1, k2, label = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), [None] * part.num_rows
                if len(some):
                    own = np.append(first[some], first[-1])
                    k1[some], k2[some] = set_keys(value, own)
                    for i, row in zip(some, labels(value, own, trees, depth)):
                        label[i] = row.tobytes()
                empty = np.ones(part.num_rows, bool)
                empty[some] = False
                yield pa.record_batch({"id": part["id"], "row_key": part["row_key"], "k1": pa.array(k1, mask=empty), "k2": pa.array(k2, mask=empty), "label": pa.array(label, pa.binary())})

    return source.mapInArrow(run, f"id {kind}, row_key bigint, k1 bigint, k2 bigint, label binary")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row_key and text of each row."""
    return docs.select(F.xxhash64(F.col(doc_id), F.col(text).cast("string")).alias("row_key"), F.col(text).cast("string").alias("text"))


def _neighbours(rows: DataFrame, width: int) -> DataFrame:
    """Edges (a, b) between classes whose sorted labels share the first ``width`` bytes in a tree.

    ``rows``: tree, label, k. Sorted by range; a task links each row to the first of its run, and gives its own first and last row as a
    border. Borders, two for each task, are compared on the driver.
    """
    ordered = rows.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label")

    def run(batches):
        key = first_key = head = last = None
        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, label, k = batch["tree"].to_pylist(), batch["label"].to_pylist(), batch["k"].to_pylist()
            a, b = [], []
            for t, x, node in zip(tree, label, k):
                own = (t, x[:width])
                if first_key is None:
                    first_key, part = own, node
                if own != key:
                    key, head = own, node
                elif node != head:
                    a.append(head)
                    b.append(node)
                last = node
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "tree": pa.array([None] * len(a), pa.int32()), "label": pa.array([None] * len(a), pa.binary())})
        if first_key is not None:
            yield pa.record_batch({"a": [part, last], "b": pa.array([None, None], pa.int64()), "tree": pa.array([first_key[0], key[0]], pa.int32()), "label": [first_key[1], key[1]]})

    found = cut_lineage(ordered.mapInArrow(run, "a bigint, b bigint, tree int, label binary"))
    border = found.where(F.col("b").isNull()).collect()
    heads: dict[tuple, int] = {}
    across = []
    for r in border:
        key = (r["tree"], bytes(r["label"]))
        if heads.setdefault(key, r["a"]) != r["a"]:
            across.append((heads[key], r["a"]))
    edges = found.where(F.col("b").isNotNull()).select("a", "b")
    return edges.unionAll(rows.sparkSession.createDataFrame(across, "a bigint, b bigint")) if across else edges


def similar_pairs(value: np.ndarray, first: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of ``low``, j of ``high``) that share a prefix in a tree and whose sets have at least the threshold's similarity.

    ``label``: (texts, trees) prefix hashes. Within one block, low is high, each pair is given once.
    """
    same = len(low) == len(high) and np.array_equal(low, high)
    near = np.zeros((len(low), len(high)), bool)
    for t in range(label.shape[1]):
        near |= label[low, t][:, None] == label[high, t][None, :]
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if not len(i):
        return low[:0], high[:0]
    size = np.diff(first)
    fits = np.minimum(size[low[i]], size[high[j]]) >= threshold * np.maximum(size[low[i]], size[high[j]])
    i, j = i[fits], j[fits]
    if len(i) <= 4000:
        common = np.array([len(np.intersect1d(value[first[a]:first[a + 1]], value[first[b]:first[b + 1]], assume_unique=True)) for a, b in zip(low[i], high[j])], np.int64)
    else:  # many pairs: products of 0/1 matrices over the shingles that two sets have, a slice of shingles at a time
        texts = np.unique(np.concatenate([low, high]))
        spots = np.concatenate([np.arange(first[x], first[x + 1]) for x in texts])
        rows = np.repeat(np.arange(len(texts)), size[texts])
        kinds, column, often = np.unique(value[spots], return_inverse=True, return_counts=True)
        shared = np.cumsum(often > 1) - 1
        keep = often[column] > 1
        rows, column = rows[keep], shared[column[keep]]
        width = int((often > 1).sum())
        a, b = np.searchsorted(texts, low), np.searchsorted(texts, high)
        product = np.zeros((len(low), len(high)), np.float32)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        for at in range(0, width, 2048):
            lo, hi = np.searchsorted(column, [at, at + 2048])
            grid = np.zeros((len(texts), min(2048, width - at)), np.float32)
            grid[rows[lo:hi], column[lo:hi] - at] = 1
            product += grid[a] @ grid[b].T
        common = product[i, j].astype(np.int64)
    linked = common >= threshold * (size[low[i]] + size[high[j]] - common) - 1e-9
    return low[i[linked]], high[j[linked]]


def _verified(candidates: DataFrame, size: int, trees: int, depth: int, width: int, threshold: float) -> DataFrame:
    """k, links, root for each class and block pair. ``candidates``: g (work group), lo, hi, root (group of candidates), block, k, text."""

    def run(table: pa.Table) -> pa.Table:
        k = table["k"].to_numpy()
        order = np.argsort(k)
        table, k = table.take(pa.array(order)), k[order]
        value, first = shingle_sets(words_of(*flat(table["text"])), size)
        marks = labels(value, first, trees, depth).reshape(len(k), trees, depth)[:, :, :width].astype(np.uint64)
        prefix = np.zeros((len(k), trees), np.uint64)
        for d in range(width):
            prefix = mix(prefix ^ (marks[:, :, d] + np.uint64(d << 16) + np.uint64(1)))
        group, block = table["root"].to_numpy(), table["block"].to_numpy()
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        links, a, b = np.zeros(len(k), np.int64), [], []
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        for members in np.split(order, cuts):
            low, high = (members, members) if lo == hi else (members[block[members] == lo], members[block[members] == hi])
            i, j = similar_pairs(value, first, prefix, low, high, threshold)
            links += np.bincount(i, minlength=len(k)) + np.bincount(j, minlength=len(k))
            a.append(i)
            b.append(j)
        node, root = forest(k[np.concatenate(a)], k[np.concatenate(b)])
        roots = k.copy()
        roots[np.searchsorted(k, node)] = root  # k is sorted, as np.unique gives it
        return pa.table({"k": k, "links": links, "root": roots})

    return candidates.groupBy("g", "lo", "hi").applyInArrow(run, "k bigint, links bigint, root bigint")


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH,
    recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """One row for each row of ``docs``: the id, ``class_id`` (smallest id of its group of near copies), ``copy_of`` (smallest id with the same
    shingles), ``n_copies`` (rows with the same shingles, itself included) and ``n_links`` (different texts that it is similar to)."""
    out = _grouped(docs, doc_id, text, threshold, size, trees, depth, recall, block)
    return out.select(F.col("id").alias(doc_id), "class_id", "copy_of", "n_copies", "n_links")


def _grouped(docs: DataFrame, doc_id: str, text: str, threshold: float, size: int, trees: int, depth: int, recall: float, block: int) -> DataFrame:
    """id, row_key, class_id, copy_of, n_copies, n_links and ``cluster``, a number that the rows of a group share (null without words)."""
    signed = cut_lineage(_signed(docs, doc_id, text, size, trees, depth))
    classes = signed.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(
        F.min("id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"), F.min_by("label", "row_key").alias("label"), F.min("row_key").alias("row_key")
    ).withColumn("k", F.xxhash64("k1", "k2"))
    classes = cut_lineage(classes)
    width = 2 * matched_depth(threshold, trees, depth, recall)
    cut = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.substring(F.col("label"), t * (2 * depth) + 1, F.lit(2 * depth)).alias("label")))
    rows = classes.select(F.explode(cut).alias("x"), "k").select("x.tree", "x.label", "k")
    groups = components(_neighbours(rows, width))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    ways = F.ceil(F.col("m") / block).cast("int")
    placed = groups.join(sizes, "root").select("node", "root", ways.alias("ways"), F.pmod(F.xxhash64("node"), ways).cast("int").alias("block"))
    placed = cut_lineage(placed.join(classes.select(F.col("k").alias("node"), "row_key"), "node"))
    bundles = max(1, -(-placed.count() // (2 * block)))
    work = placed.join(_texts(docs, doc_id, text), "row_key").dropDuplicates(["node"]).select(
        F.when(F.col("ways") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bundles))).alias("g"),
        F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("other"), "root", "block", "ways", F.col("node").alias("k"), "text",
    ).select("g", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "root", "block", "ways", "k", "text")
    # a class of several blocks shares no work group with bundles: their blocks are numbered from -1
    work = work.select("g", *(F.when(F.col("ways") > 1, F.col(c)).otherwise(F.lit(-1)).alias(c) for c in ("lo", "hi", "block")), "root", "k", "text")
    found = cut_lineage(_verified(work, size, trees, depth, width // 2, threshold))
    links = found.groupBy("k").agg(F.sum("links").alias("n_links"))
    joined = components(found.where("k <> root").select(F.col("k").alias("a"), F.col("root").alias("b")))
    members = classes.select("k", "k1", "k2", "copy_of", "n_copies").join(joined.withColumnRenamed("node", "k"), "k", "left")
    least = members.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("copy_of").alias("class_id"))
    members = members.join(least, "root", "left").join(links, "k", "left").select(
        "k1", "k2", "copy_of", "n_copies", F.coalesce("root", "k").alias("cluster"), F.coalesce("class_id", "copy_of").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    out = signed.drop("label").join(members, ["k1", "k2"], "left")
    return out.select(
        "id", "row_key", "cluster", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_of", "id").alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH,
    recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, then of the smallest hash of id and text; of rows that repeat both, one.

    A null id comes after all ids: such a row goes if a copy with an id stays, and of several without an id one stays. Rows without words are groups
    of their own and all stay.
    """
    names = docs.columns
    plain = docs.toDF(*(f"x{i}" for i in range(len(names))))
    at_id, at_text = f"x{names.index(doc_id)}", f"x{names.index(text)}"
    own = cut_lineage(
        _grouped(plain, at_id, at_text, threshold, size, trees, depth, recall, block).where(F.col("cluster").isNotNull()).select("id", "row_key", "cluster"))
    stays = own.groupBy("cluster").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key"))["row_key"].alias("row_key"))
    gone = own.select("row_key", "cluster").distinct().join(stays.withColumn("stays", F.lit(True)), ["cluster", "row_key"], "left").where(F.col("stays").isNull()).select("row_key")
    left = plain.withColumn("row_key", F.xxhash64(F.col(at_id), F.col(at_text).cast("string"))).join(gone, "row_key", "left_anti")
    again = own.groupBy("row_key").count().where("count > 1").select("row_key")  # rows that repeat id and text
    cols = [f"x{i}" for i in range(len(names))]
    if again.head() is None:
        return left.select(*cols).toDF(*names)
    left = left.join(again.withColumn("again", F.lit(True)), "row_key", "left")
    once = left.where("again").groupBy("row_key").agg(F.first(F.struct(*cols)).alias("x")).select("x.*")
    return left.where(F.col("again").isNull()).select(*cols).unionAll(once).toDF(*names)

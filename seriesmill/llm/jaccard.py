"""Similarity join of texts by the Jaccard index of their word n-grams: MinHash LSH forest.

1. Every text becomes its set of n-grams; texts with the same set are one node.
2. A node has one label of minimum hashes per tree.  Nodes that share a label prefix in any tree
   are candidates; the prefix is shortened from the full label until a pair at the threshold shares
   one with the target probability.  A trie node with many members links them to one of them,
   never to each other, so candidates are linear in the members.
3. Connected candidates form a cluster.  Its texts are brought together once, dealt over tiles of
   bounded size, and every two texts of two tiles are compared exactly; tiles return numbers of
   links and a spanning forest, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from seriesmill.llm.common import FILE, ROW, restored, set_aside, stored, with_row_keys
from seriesmill.llm.components import components
from seriesmill.llm.memo import slices
from seriesmill.session import bounded_broadcast

SIZE, THRESHOLD = 5, 0.8
TREES, LABEL, RECALL = 32, 12, 0.999
# A tile holds about so many texts, a long text counting once for each 1,000 words.
TILE, TILE_WORDS = 256, 1000
SLICE_BYTES = 4 << 20


def prefix_depth(threshold: float, trees: int, label: int, recall: float) -> int:
    """Longest prefix that a pair at the threshold shares in some tree with the given probability."""
    for depth in range(label, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


class Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingles:
    def __init__(self, size: int):
        self.size, self.words = size, Words()
        self.factors = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 | 1) for k in range(size)]

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the n-grams of white-space separated words; a shorter text is
        one n-gram, a text without words has none."""
        words = text.split()
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(" ".join(words))] if words else [], np.uint64)
        count = len(words) - self.size + 1
        value = np.zeros(count, np.uint64)
        for k, factor in enumerate(self.factors):
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k:k + count] * factor
        return np.unique(value ^ (value >> np.uint64(32)))


class Forest:
    """Prefixes of the labels of a set, one per tree."""

    def __init__(self, trees: int, depth: int, seed: int = 11):
        random = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.a = (random.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = random.integers(0, 1 << 32, trees * depth, dtype=np.uint32)[:, None]

    def prefixes(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.trees * self.depth, 0xFFFFFFFF, np.uint32)
        for start in range(0, len(low), 1024):
            np.minimum(least, (self.a * low[start:start + 1024] + self.b).min(axis=1), out=least)
        value = np.full(self.trees, 0x243F6A8885A308D3, np.uint64)
        for column in least.reshape(self.trees, self.depth).T.astype(np.uint64):
            value = (value ^ column) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        return value.view(np.int64)


def signed(keyed: DataFrame, text: str, doc_id: str, size: int, trees: int, depth: int) -> DataFrame:
    """FILE, ROW, doc_id, node (digest of the n-gram set), prefixes, weight (thousands of words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, forest = Shingles(size), Forest(trees, depth)
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
                nodes, prefixes, weights = [], [], []
                for text in texts.slice(low, high - low).to_pylist():
                    found = shingles.of(text)
                    nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    prefixes.append(forest.prefixes(found))
                    weights.append(1 + len(found) // TILE_WORDS)
                offsets = np.arange(0, trees * (high - low) + 1, trees, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(low, high - low) for c in (FILE, ROW, "doc_id")), pa.array(nodes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes))), pa.array(weights, pa.int64()),
                ], names=[FILE, ROW, "doc_id", "node", "prefixes", "weight"])

    rows = keyed.select(FILE, ROW, F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"{FILE} long, {ROW} long, doc_id {kind}, node binary, prefixes array<long>, weight long")


def compare(first: list[np.ndarray], second: list[np.ndarray] | None, threshold: Fraction) -> np.ndarray:
    """Which sets of `first` and `second` (or of `first` among themselves) are similar enough."""
    sets = first + (second or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # all others meet nothing
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    rows, columns = len(first), slice(len(first), None) if second else slice(None)
    common = np.zeros((rows, len(sets[columns])), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        low, high = np.searchsorted(column, (start, start + 4096))
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[low:high], column[low:high] - start] = 1
        common += block[:rows] @ block[columns].T
    size = np.array([len(s) for s in sets], np.int64)
    p, q = threshold.numerator, threshold.denominator
    both = size[:rows, None] + size[columns]
    similar = common.astype(np.int64) * (p + q) >= p * both
    similar &= both > 0
    if second is None:
        np.fill_diagonal(similar, False)
    return similar


def forest_roots(similar: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component in a symmetric matrix."""
    label = np.arange(len(similar))
    while True:
        near = np.where(similar, label, len(label)).min(axis=1, initial=len(label))
        after = np.minimum(label, near)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def verified(members: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, root, links, other_texts) per node and tile pair, from members with their texts."""
    exact = Fraction(str(threshold))

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values(["tile", "node"]).reset_index(drop=True)
        shingles = Shingles(size)
        sets = [shingles.of(t) for t in pair["text"]]
        copies = pair["copies"].to_numpy()
        low, high = int(pair["low"].iloc[0]), int(pair["high"].iloc[0])
        split = int((pair["tile"] == low).sum())
        n = len(pair)
        similar = np.zeros((n, n), bool)
        if low == high:
            similar[:] = compare(sets, None, exact)
        elif 0 < split < n:
            similar[:split, split:] = compare(sets[:split], sets[split:], exact)
            similar |= similar.T
        root = forest_roots(similar)
        return pd.DataFrame({
            "node": pair["node"], "root": pair["node"].to_numpy()[root], "tiles": pair["tiles"],
            "links": similar @ copies, "other_texts": similar.sum(axis=1)})

    pairs = members.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn(
        "low", F.least("tile", "with")).withColumn("high", F.greatest("tile", "with"))
    columns = ["cluster", "low", "high", "tile", "tiles", "node", "copies", "text"]
    return pairs.select(*columns).groupBy("cluster", "low", "high").applyInPandas(
        run, "node binary, root binary, tiles long, links long, other_texts long")


def _classes(
    keyed: DataFrame, text: str, doc_id: str, size: int, threshold: float, trees: int, label: int, recall: float
) -> DataFrame:
    depth = prefix_depth(threshold, trees, label, recall)
    rows = stored(signed(keyed, text, doc_id, size, trees, depth), "signed")
    nodes = stored(rows.groupBy("node").agg(
        F.min(F.struct("doc_id", FILE, ROW)).alias("keeper"), F.min("doc_id").alias("least_id"),
        F.count(F.lit(1)).alias("copies"), F.max("weight").alias("weight"),
        F.any_value("prefixes").alias("prefixes")), "nodes")

    # The short name of a node serves for candidates only: two nodes of one name share a cluster.
    named = nodes.select(F.xxhash64("node").alias("u"), F.posexplode("prefixes").alias("tree", "prefix"))
    heads = named.groupBy("tree", "prefix").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    candidates = named.join(heads.drop("n"), ["tree", "prefix"]).select("u", "v").distinct()
    clusters = components(candidates).select(F.col("node").alias("name"), F.col("root").alias("cluster"))
    members = nodes.withColumn("name", F.xxhash64("node")).join(clusters, "name").select(
        "node", "cluster", "copies", "weight", F.col(f"keeper.{FILE}").alias(FILE), F.col(f"keeper.{ROW}").alias(ROW))
    members = stored(members, "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("weight") / TILE).alias("tiles"))
    dealt = members.join(sizes, "cluster").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")))
    texts = keyed.select(FILE, ROW, F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = stored(verified(texts.join(bounded_broadcast(dealt), [FILE, ROW]), size, threshold), "verified")

    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("other_texts").alias("other_texts"))
    whole = found.where("tiles = 1").select("node", "root")
    parts = found.where("tiles > 1 and node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if parts.take(1):
        whole = whole.unionByName(components(parts))
    of_node = nodes.join(links, "node", "left").join(whole, "node", "left").select(
        "node", "keeper", "least_id", "copies", F.coalesce("root", "node").alias("class"),
        F.coalesce("links", F.lit(0)).alias("near"), F.coalesce("other_texts", F.lit(0)).alias("other_texts"))
    of_node = stored(of_node, "classes")
    chosen = of_node.groupBy("class").agg(
        F.min("keeper").alias("keeper"), F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    result = of_node.drop("keeper", "least_id").join(chosen, "class").drop("class")
    return rows.select(FILE, ROW, "doc_id", "node").join(result, "node").select(
        "doc_id", FILE, ROW, "class_id", "class_size", (F.col("near") + F.col("copies") - 1).alias("links"), "other_texts",
        F.struct("doc_id", FILE, ROW).eqNullSafe(F.col("keeper")).alias("kept"))


def similar_texts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, threshold: float = THRESHOLD,
    trees: int = TREES, label: int = LABEL, recall: float = RECALL,
) -> DataFrame:
    """One row per input row: doc_id, FILE, ROW, class_id, class_size, links, other_texts, kept.

    Rows whose sets have a Jaccard index of `threshold` or more are linked; links counts all rows
    linked to a row, copies included, and other_texts the different sets among them.  Linked rows
    form a class (transitively), named by its smallest doc_id, whose row is `kept`.  A null text is
    empty; texts without a word are one class; a null id is smaller than any other.  Repeated rows
    are copies; other columns are ignored; an empty table gives an empty result.
    """
    return _classes(with_row_keys(docs.select(doc_id, text)), text, doc_id, size, threshold, trees, label, recall)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, one of each class, with the columns of `docs`."""
    inner, (text, doc_id) = set_aside(docs, text, doc_id)
    keyed = with_row_keys(inner)
    classes = _classes(keyed, text, doc_id, SIZE, THRESHOLD, TREES, LABEL, RECALL)
    dropped = bounded_broadcast(stored(classes.where(~F.col("kept")).select(FILE, ROW), "dropped"))
    return restored(keyed.join(dropped, [FILE, ROW], "left_anti"), docs)

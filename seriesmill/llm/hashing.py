"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Several rotations learned on a bounded sample turn every vector into 256 signs.  A code is split into
16 substrings of 16 bits and each substring is an index of its own.  A code within radius r of the
query is, by the pigeonhole principle, within r // 16 of it in one of the first r % 16 + 1 substrings
or within r // 16 - 1 in one of the others; probing those buckets therefore retrieves every code within
r.  Where these buckets would hold as many codes as there are (a radius too large to prune by
substrings), all codes of the block are compared instead.  Only codes within the radius are reranked,
by the inner product of the original vectors.

The radius is where the sample's true neighbours lie within it; a query that finds too few widens
it, at last to all codes.  Equal vectors are one code with its smallest ids.  Index and queries
are dealt over blocks, and every block of the index meets every block of the stated queries.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from seriesmill.llm.common import stored

BITS, PART = 256, 16
SAMPLE, SAMPLE_QUERIES, QUANTILE = 16_384, 256, 0.98
INDEX_BLOCK, QUERY_BLOCK = 16_384, 4096
ROUNDS = 30
_ONES = np.bitwise_count(np.arange(1 << PART, dtype=np.uint16))


def learn_rotation(vectors: np.ndarray, seed: int = 3) -> np.ndarray:
    """Columns whose signs are the code: iterative quantisation of the sample's principal axes, as many
    times from different starts as it takes to have BITS columns.  A sample of one vector gives random
    directions."""
    random = np.random.default_rng(seed)
    size = vectors.shape[1]
    if len(vectors) < 2:
        return random.standard_normal((size, BITS))
    _, axes = np.linalg.eigh(vectors.T @ vectors / len(vectors))
    axes = axes[:, ::-1][:, :BITS]
    flat, columns = vectors @ axes, []
    for _ in range(-(-BITS // axes.shape[1])):
        turn = np.linalg.qr(random.standard_normal((axes.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (left @ right).T
        columns.append(axes @ turn)
    return np.concatenate(columns, axis=1)[:, :BITS]


def encode(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of bytes."""
    return np.packbits(vectors @ rotation > 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)


def learn_radius(vectors: np.ndarray, rotation: np.ndarray, k: int) -> int:
    """Distance within which QUANTILE of the sample's true neighbours lie."""
    codes = encode(vectors, rotation)
    found = []
    for i in range(min(SAMPLE_QUERIES, len(vectors))):
        score = vectors @ vectors[i]
        score[i] = -np.inf
        near = np.argpartition(-score, min(k, len(score)) - 1)[:k]
        found.append(distances(codes[near], codes[i]))
    return int(np.quantile(np.concatenate(found), QUANTILE)) if found else BITS


class MultiIndex:
    """The substring indexes of one block of codes; `probed` counts the codes that were looked at."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.bits = codes, 8 * codes.shape[1]
        self.parts = codes.view(np.uint16)
        self.order = [np.argsort(p, kind="stable") for p in self.parts.T]
        self.edges = [np.searchsorted(p[o], np.arange((1 << PART) + 1)) for p, o in zip(self.parts.T, self.order, strict=True)]
        self.probed = 0

    def bucket(self, j: int, part: int, radius: int) -> np.ndarray:
        """Codes whose substring j is within the radius of `part`."""
        values = np.nonzero(_ONES[np.arange(1 << PART, dtype=np.uint16) ^ np.uint16(part)] <= radius)[0]
        edges = self.edges[j]
        values = values[edges[values + 1] > edges[values]]
        return np.concatenate([self.order[j][edges[v]:edges[v + 1]] for v in values]) if len(values) else np.zeros(0, np.int64)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every code within the radius."""
        everything = np.arange(len(self.codes))
        if radius >= self.bits:
            self.probed += len(everything)
            return everything
        number = self.parts.shape[1]
        low, rest = divmod(radius, number)
        near = [low if j <= rest else low - 1 for j in range(number)]
        # Share of all values of a substring that the probes of each index ask for.
        asked = sum(sum(comb(PART, i) for i in range(n + 1)) for n in near) / (1 << PART)
        found = everything
        if asked < 1:
            seen = np.zeros(len(self.codes), bool)
            for j, part in enumerate(code.view(np.uint16)):
                if near[j] >= 0:
                    seen[self.bucket(j, int(part), near[j])] = True
            found = np.nonzero(seen)[0]
        self.probed += len(found)
        return found[distances(self.codes[found], code) <= radius]


def search_block(index: pd.DataFrame, queries: pd.DataFrame, rotation: np.ndarray, radius: int, k: int) -> pd.DataFrame:
    """The k best rows of one block for each query, ties to the smaller id; all if fewer."""
    if index.empty or queries.empty:
        return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype({"query": "int64", "vec_id": "int64"})
    vectors, asked = np.stack(index["vec"].to_numpy()), np.stack(queries["vec"].to_numpy())
    ids = index["ids"].to_numpy()
    held = np.array([len(x) for x in ids])
    multi, codes = MultiIndex(encode(vectors, rotation)), encode(asked, rotation)
    rows: list[tuple[np.ndarray, ...]] = []
    for name, query, code in zip(queries["query"], asked, codes, strict=True):
        reach = radius
        found = multi.within(code, reach)
        while held[found].sum() < k and reach < BITS:
            reach += PART
            found = multi.within(code, reach)
        score = vectors[found] @ query
        if len(found) > k:
            kept = score >= np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[kept], score[kept]
        names = np.concatenate([ids[i] for i in found])
        scores = np.repeat(score, held[found])
        best = np.lexsort((names, -scores))[:k]
        rows.append((np.full(len(best), name), names[best], scores[best]))
    return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query", "vec_id", "score"), zip(*rows, strict=True), strict=True)})


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vec) of rows that take part: vectors of the table's usual length whose components are
    all finite and not all zero, with an id.  A repeated row counts once."""
    sound = F.col(vector).isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = rows.where(sound).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    length = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.where(F.size("vec") == (length["n"] if length else 0)).distinct()


def nearest(
    rows: DataFrame, is_query: str, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which the SQL condition `is_query` over `id` holds,
    the k rows with the largest inner product that were found, the row itself left out.

    Null, zero and non-finite vectors, and those of another length than most, take no part.  Ties go to the smaller id; fewer than k rows
    give all.  Repeated rows count once; two vectors of one id never find each other; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    sound = stored(usable(rows, vec_id, vector), "vectors")
    # Of equal vectors only the k + 1 smallest ids can be an answer.
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    index = sound.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vec").agg(
        F.sort_array(F.collect_list("id")).alias("ids"))
    index = stored(index, "index")
    asked = sound.where(is_query)
    queries = stored(asked.groupBy("vec").agg(F.min("id").alias("query")), "queries")
    drawn = index.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).collect()  # bounded
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r["vec"] for r in drawn])
    rotation = learn_rotation(sample)
    radius = learn_radius(sample, rotation, k)

    # Blocks are dealt by hash; index blocks times query blocks is the number of tasks.
    many = lambda df, size: max(1, -(-df.count() // size))
    blocks, groups = many(index, INDEX_BLOCK), many(queries, QUERY_BLOCK)
    deal = lambda name, n: F.pmod(F.xxhash64("vec"), F.lit(n)).cast("int").alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = index.select("vec", "ids", deal("block", blocks), every("group", groups)).groupBy("block", "group")
    right = queries.select("vec", "query", deal("group", groups), every("block", blocks)).groupBy("block", "group")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search_block(a, b, rotation, radius, k + 1)

    found = left.cogroup(right).applyInPandas(run, "query long, vec_id long, score double")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    lists = best.where(F.col("place") <= k + 1).groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("found"))
    names = asked.join(queries, "vec").select(F.col("id").alias("query_id"), "query")
    own = names.join(lists, "query").select(
        "query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("place", "f")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "f.vec_id", (-F.col("f.down")).alias("score"))

"""Importance resampling of documents towards a target distribution.

1. A text, its letters A-Z in lower case, is pre-tokenised by an untrained Split of the `tokenizers`
   library into words with offsets.  A feature is a run of consecutive words: the words stand one
   space apart in one string, and a run is the slice between the offset of its first word and that
   of its last.  The CRC of a feature names its bucket.
2. One pass over the texts writes, for each document, its buckets with counts and, for each task, the
   histogram of all that it read, so that the corpus histogram is a sum over tasks.
3. A bucket's gain is the logarithm of its smoothed share in the target over that in the corpus; a
   document's weight is the mean gain of its features.  Gumbel noise from a hash of the id makes
   drawing without replacement a sort by score.  The sort is by ranges over all tasks; a rank is the
   place within a task and the rows before that task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from seriesmill.llm.common import FILE, ROW, stored, with_row_keys
from seriesmill.llm.memo import slices

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST_RUN = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
# Characters that are split at a time; a longer text is cut where no word is.
PIECE, SLICE_BYTES = 1 << 17, 1 << 20
REMEMBERED, LONGEST_KEY = 500_000, 64
_gap = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
FEATURES = ["n_words", "n_features", "buckets", "counts"]


class Buckets(dict):
    """Feature -> bucket."""

    def __init__(self, number: int):
        super().__init__()
        self.number = number

    def __missing__(self, feature: str) -> int:
        value = zlib.crc32(feature.encode()) % self.number
        if len(feature) <= LONGEST_KEY:
            if len(self) >= REMEMBERED:
                self.clear()
            self[feature] = value
        return value


class Features:
    def __init__(self, longest_run: int, buckets: int):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.longest_run, self.buckets = longest_run, Buckets(buckets)
        self.split = Split(Regex(WORD), "removed", invert=True)

    def words(self, text: str) -> list[str]:
        text = text.encode().lower().decode()  # bytes: A-Z alone
        found, start = [], 0
        while start < len(text):
            gap = _gap.search(text, start + PIECE) if len(text) - start > PIECE else None
            stop = gap.start() if gap else len(text)
            found += [word for word, _ in self.split.pre_tokenize_str(text[start:stop])]
            start = stop
        return found

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words and the bucket of every feature."""
        words = self.words(text)
        named = [np.fromiter(map(self.buckets.__getitem__, words), np.int64, len(words))]
        if self.longest_run > 1:
            joined, sizes = " ".join(words), [len(w) for w in words]
            ends = list(accumulate(sizes, lambda end, size: end + 1 + size))
            for n in range(2, self.longest_run + 1):
                pairs = ((end - size, last) for end, size, last in zip(ends, sizes, ends[n - 1:], strict=False))
                runs = [self.buckets[joined[start:stop]] for start, stop in pairs]
                named.append(np.array(runs, np.int64))
        return len(words), np.concatenate(named)


def features(keyed: DataFrame, longest_run: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """FILE, ROW, doc_id, n_words, n_features, buckets, counts of the texts of a table with row keys, and one
    row without a key for each task, with the histogram of all that it read."""
    columns = [FILE, ROW, "doc_id"]
    names = [*columns, *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total, kinds = Features(longest_run, buckets), np.zeros(buckets, np.int64), None

        def lists(parts: list[np.ndarray]) -> pa.ListArray:
            offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int64)))

        for batch in batches:
            texts, kinds = batch.column("text"), [batch.schema.field(c).type for c in columns]
            for low, high in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
                words, sizes, held, counts = [], [], [], []
                for text in texts.slice(low, high - low).to_pylist():
                    n, named = reader.of(text)
                    own, count = np.unique(named, return_counts=True)
                    total[own] += count
                    words.append(n)
                    sizes.append(len(named))
                    held.append(own)
                    counts.append(count)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in columns), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()),
                     lists(held), lists(counts)], names=names)
        if kinds and total.any():
            own = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, kind) for kind in kinds), *(pa.nulls(1, pa.int64()) for _ in range(2)), lists([own]), lists([total[own]])],
                names=names)

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.select(*columns, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"{FILE} long, {ROW} long, doc_id {kind}, n_words long, n_features long, buckets array<long>, counts array<long>")


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all tasks of `features`: `buckets` numbers."""
    pairs = found.where(F.col(FILE).isNull()).select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    rows = pairs.groupBy("p.buckets").agg(F.sum("p.counts").alias("n")).toPandas()  # a row for each bucket
    counts = np.zeros(buckets, np.int64)
    counts[rows["buckets"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the corpus, floored."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = (target + 1.0) * (s + n) / ((corpus + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """FILE, ROW, doc_id, n_words, n_features, weight: the floored mean gain of a document's features."""
    columns = [FILE, ROW, "doc_id", "n_words", "n_features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, counts = batch.column("buckets"), batch.column("counts")
            each = gain[held.flatten().to_numpy()] * counts.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(each)])
            stop = np.cumsum(pc.list_value_length(held).to_numpy())
            total = np.diff(ends[stop], prepend=0)
            size = batch.column("n_features").to_numpy()
            weight = np.where(size > 0, total // np.maximum(size, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(weight)], names=[*columns, "weight"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.where(F.col(FILE).isNotNull()).mapInArrow(
        run, f"{FILE} long, {ROW} long, doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Adds rank (1 for the highest score, ties to the smaller doc_id) to the first `percent` of all rows.

    Rows equal in both come in the order of their places in the files.  The sort deals rows over tasks
    by ranges that end anywhere, so rows of one score or id need not meet in one task.
    """
    place = "__place"
    ordered = scored.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), FILE, ROW)
    ordered = stored(ordered.select("*", F.monotonically_increasing_id().alias(place)), "ordered")
    task, within = F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)
    # One row for each task of the sort.
    sizes = sorted(tuple(r) for r in ordered.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("rows")).collect())
    before = list(accumulate((n for _, n in sizes), initial=0))
    drawn = percent * before[-1] // 100
    starts = ordered.sparkSession.createDataFrame(
        [(t, b) for (t, _), b in zip(sizes, before, strict=False)], "__task long, __before long")
    rank = F.col("__before") + within + 1
    return ordered.join(F.broadcast(starts), task == F.col("__task")).select(
        *scored.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
    longest_run: int = LONGEST_RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per document: FILE, ROW, doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    Drawn are `percent` of the documents with `least_words` words or more.  A null text has no words
    and weight 0; rows with a null id share the noise of the empty id and come last among equal scores;
    repeated rows are drawn one by one; texts of any length are read whole, in pieces; other columns
    are ignored.  Without a target text every bucket's share in the target is the same; an empty
    table gives an empty result.
    """
    keyed = with_row_keys(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    found = stored(features(keyed, longest_run, buckets), "features")
    wanted = with_row_keys(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")))
    aim = histogram(features(wanted, longest_run, buckets), buckets)
    rows = weighted(found, gains(histogram(found, buckets), aim))
    scored = stored(rows.withColumn("score", F.col("weight") + noise("doc_id", seed)), "scored")
    left = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(F.col("n_words") >= least_words), percent).unionByName(left)

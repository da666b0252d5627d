"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of characters.

The model counts the character 5-grams of trusted texts.  Lower orders count in how many ways an
n-gram continues to the left, so every order follows from the distinct n-grams of the next one by
a grouped count.  A 5-gram travels as its hash and its characters; shorter ones follow from these.

Scoring gathers the distinct 5-grams of all documents, joins them with the counts of every order
(sharded by hash) and gets one log-probability per 5-gram.  Documents look their 5-grams up in
that table: as one array per task while the table is small by a checked count, by joining the
partition's own share otherwise.  A document is kept if its perplexity is at most its language's
quantile over trusted documents that the model was not trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from seriesmill.llm.common import FILE, ROW, fold, stored, with_row_keys
from seriesmill.llm.memo import slices, spans
from seriesmill.session import bounded_broadcast

ORDER = 5
QUANTILE, ACCURACY = 0.995, 10_000
# Folds of the id: none of the held-out fold is looked at, one gives the quantiles (a model finds the
# texts that it was trained on too likely), the others train.
HELD_OUT, QUANTILE_FOLD = 0, 1
START, END = "\x02", "\x03"
SLICE_BYTES, HELD = 1 << 20, 1_500_000
# Distinct n-grams that are sent to every task as two arrays (12 bytes each); more are joined.
TABLE_ROWS = 4_000_000
# Documents of one scoring group, in characters, where the table is joined.
GROUP_CHARS = 16 << 20

GRAMS = [f"g{n}" for n in range(ORDER, 0, -1)]
CONTEXTS = [f"c{n}" for n in range(ORDER, 1, -1)]
_space = re.compile(r"\s+")


def normalised(text: str) -> str:
    return START * (ORDER - 1) + _space.sub(" ", text.lower()) + END


def _hash(points: list[np.ndarray]) -> np.ndarray:
    value = np.full(len(points[0]), 0x9E3779B97F4A7C15 + len(points), np.uint64)
    for p in points:
        value = (value ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(31)
    return value


def five_grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The characters of every 5-gram of all texts, one array per place, and 5-grams per text."""
    marked = [normalised(t) for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], np.int64)
    counts = sizes - ORDER + 1
    at = spans(np.cumsum(sizes) - sizes, counts)
    return [points[at + k] for k in range(ORDER)], counts


def packed(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 5-gram's characters in two numbers: 21 bits each, the first two and the last three."""
    a, b, c, d, e = (p.view(np.int64) for p in places)
    return a << 21 | b, c << 42 | d << 21 | e


def named(grams: DataFrame) -> DataFrame:
    """Adds the n-grams that end a 5-gram (g4 to g1) and their contexts (c5 to c2) to its characters."""
    one = (1 << 21) - 1
    hi, lo = F.col("hi"), F.col("lo")
    second, front = hi.bitwiseAND(one), F.shiftright(lo, 21)
    return grams.withColumns({
        "g4": F.xxhash64(second, lo), "g3": lo, "g2": lo.bitwiseAND((1 << 42) - 1), "g1": lo.bitwiseAND(one),
        "c5": F.xxhash64(hi, front), "c4": F.shiftleft(second, 42).bitwiseOR(front), "c3": front, "c2": front.bitwiseAND(one),
    }).drop("hi", "lo")


def gathered(rows: DataFrame) -> DataFrame:
    """Distinct 5-grams of `text` per task with their counts: g5, its characters hi and lo, n."""
    columns = ["g5", "hi", "lo", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            key, hi, lo, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            _, first, at = np.unique(key, return_index=True, return_inverse=True)
            return [key[first], hi[first], lo[first], np.bincount(at, n, len(first)).astype(np.int64)]

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=columns)

        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
                places, _ = five_grams(texts.slice(low, high - low).to_pylist())
                key, first, n = np.unique(_hash(places).view(np.int64), return_index=True, return_counts=True)
                part = [key, *packed([p[first] for p in places]), n]
                held = merged([held, part]) if held else part
                if len(held[0]) > HELD:
                    yield out(held)
                    held = None
        if held:
            yield out(held)

    return rows.select("text").mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def distinct_grams(rows: DataFrame) -> DataFrame:
    """g5 to g1, c5 to c2 and n of the distinct 5-grams of all rows."""
    whole = gathered(rows).groupBy("g5").agg(F.any_value("hi").alias("hi"), F.any_value("lo").alias("lo"), F.sum("n").alias("n"))
    return named(whole)


def order_tables(trusted: DataFrame) -> dict[int, DataFrame]:
    """For each order n: gn, cn, count (occurrences for the highest, left continuations below)."""
    tables, above = {}, None
    for n in range(ORDER, 0, -1):
        if above is None:
            grams = distinct_grams(trusted).withColumnRenamed("n", "count")
        else:
            rest = [F.any_value(c).alias(c) for c in [*GRAMS[ORDER - n + 1:], *CONTEXTS[ORDER - n:]]]
            grams = above.groupBy(f"g{n}").agg(F.count(F.lit(1)).alias("count"), *rest)
        above = stored(grams, f"order-{n}")
        tables[n] = above
    return tables


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more from the numbers of n-grams that occur 1 to 4
    times, kept between 0.05 and the count less 0.05: something is always left for what was never seen."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True))


def discounted(count: Column, d: tuple[float, float, float]) -> Column:
    return F.when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


class Model:
    """Counts of every order with their discounts and contexts."""

    def __init__(self, trusted: DataFrame):
        self.tables = order_tables(trusted)
        # One job for all orders: how many n-grams occur once, twice, three times, four times, more often.
        counts = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("order"), "count") for n, t in self.tables.items()])
        often = counts.groupBy("order", F.least("count", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("all"))
        rows = {(r["order"], r["k"]): r for r in often.collect()}
        held = lambda n, k, what: rows[n, k][what] if (n, k) in rows else 0
        self.discounts = {n: discounts([held(n, k, "n") for k in (1, 2, 3, 4)]) for n in self.tables}
        self.total = sum(held(1, k, "all") for k in range(1, 6))
        self.taken = sum(held(1, k, "n") * self.discounts[1][min(k, 3) - 1] for k in range(1, 6))
        # One more character stands for all that were never seen.
        self.characters = sum(held(1, k, "n") for k in range(1, 6)) + 1

    def context(self, n: int) -> DataFrame:
        """cn, the occurrences after a context and what is taken from them."""
        taken = F.sum(discounted(F.col("count"), self.discounts[n]))
        return self.tables[n].groupBy(f"c{n}").agg(F.sum("count").alias("total"), taken.alias("taken"))

    def log_probabilities(self, wanted: DataFrame) -> DataFrame:
        """(g5, logp) of distinct 5-grams: from the single character up, each order is joined with its counts
        and contexts and written, so that no plan has more than two joins."""
        rows = wanted.withColumn("p", F.lit(1.0 / self.characters))
        for n in range(1, ORDER + 1):
            rows = rows.join(self.tables[n].select(f"g{n}", "count"), f"g{n}", "left")
            if n > 1:
                rows = rows.join(self.context(n), f"c{n}", "left")
                total, taken = F.col("total"), F.col("taken")
            else:
                total, taken = F.lit(float(self.total) or None).cast("double"), F.lit(float(self.taken))
            seen = F.coalesce((F.col("count") - discounted(F.col("count"), self.discounts[n])) / total, F.lit(0.0))
            p = seen + F.coalesce(taken / total, F.lit(1.0)) * F.col("p")
            left = [*GRAMS[:ORDER - n], *CONTEXTS[:ORDER - n]]
            rows = stored(rows.select(*dict.fromkeys(["g5", *left]), p.alias("p")), f"probability-{n}")
        return rows.select("g5", F.log("p").cast("float").alias("logp"))


class Table:
    """Open-addressed look-up of 64-bit keys that are all present."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = np.int64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.int64)
        self.values = np.zeros(int(self.mask) + 1, np.float32)
        taken = np.zeros(int(self.mask) + 1, bool)
        left, at = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = ~taken[at]
            slot, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.keys[slot], self.values[slot], taken[slot] = keys[put], values[put], True
            stay = ~np.isin(left, put)
            left, at = left[stay], (at[stay] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        wrong = np.nonzero(self.keys[at] != keys)[0]
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return self.values[at]


def perplexities(texts: list[str], table: Table) -> np.ndarray:
    places, counts = five_grams(texts)
    logs = table.get(_hash(places).view(np.int64)).astype(np.float64)
    return np.exp(-np.add.reduceat(logs, np.cumsum(counts) - counts) / counts)


def _with_arrays(rows: DataFrame, logs: DataFrame) -> DataFrame:
    found = logs.toArrow()  # at most TABLE_ROWS, by count; two arrays, never rows of Python objects
    given = rows.sparkSession.sparkContext.broadcast((found.column("g5").to_numpy(), found.column("logp").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*given.value)
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
                value = perplexities(texts.slice(low, high - low).to_pylist(), table)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in (FILE, ROW)), pa.array(value)], names=[FILE, ROW, "perplexity"])

    return rows.select(FILE, ROW, "text").mapInArrow(run, f"{FILE} long, {ROW} long, perplexity double")


def _with_joins(rows: DataFrame, logs: DataFrame, groups: int) -> DataFrame:
    dealt = rows.select(FILE, ROW, "text", F.pmod(F.xxhash64(FILE, ROW), F.lit(groups)).cast("int").alias("group"))

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, texts in frame.groupby("group")["text"]:
                yield pd.DataFrame({"g5": np.unique(_hash(five_grams(list(texts))[0]).view(np.int64))}).assign(group=name)

    needed = dealt.select("group", "text").mapInPandas(grams, "g5 long, group int").distinct().join(logs, "g5")

    def run(texts: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
        if texts.empty:
            return pd.DataFrame({FILE: [], ROW: [], "perplexity": []})
        table = Table(share["g5"].to_numpy(), share["logp"].to_numpy())
        return pd.DataFrame({FILE: texts[FILE], ROW: texts[ROW], "perplexity": perplexities(list(texts["text"]), table)})

    return dealt.groupBy("group").cogroup(needed.groupBy("group")).applyInPandas(
        run, f"{FILE} long, {ROW} long, perplexity double")


def score(keyed: DataFrame, model: Model, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(FILE, ROW, perplexity) of rows with a text column `text`."""
    wanted = stored(distinct_grams(keyed).drop("n"), "wanted")
    logs = model.log_probabilities(wanted)
    if logs.limit(table_rows + 1).count() <= table_rows:
        return _with_arrays(keyed, logs)
    chars = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    return _with_joins(keyed, logs, max(1, -(-chars // GROUP_CHARS)))


def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang",
    quality: str = "quality", quantile: float = QUANTILE, table_rows: int = TABLE_ROWS,
) -> DataFrame:
    """One row per document: doc_id, lang, perplexity, threshold, trusted, kept.

    Trusted are the rows that a label outside the held-out fold calls good.  The threshold is the
    quantile of a language's trusted rows in QUANTILE_FOLD, or of those of all languages for a
    language without any; without such rows everything is kept.  A null text is empty (its perplexity is that of the
    end of a text), a null language is a language of its own; repeated rows are scored one by one;
    other columns are ignored; an empty table gives an empty result.
    """
    keyed = with_row_keys(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    good = labels.where((F.col(quality) == 1) & (fold(doc_id) != HELD_OUT)).select(F.col(doc_id).alias("doc_id")).distinct()
    good = bounded_broadcast(good)
    taught = keyed.where(fold("doc_id") != QUANTILE_FOLD).join(good, "doc_id", "left_semi")
    scored = score(keyed, Model(taught.select("text")), table_rows)
    rows = keyed.select("doc_id", "lang", FILE, ROW).join(scored, [FILE, ROW])
    rows = stored(rows.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left"), "perplexity")
    trusted = rows.where(F.col("trusted") & (fold("doc_id") == QUANTILE_FOLD))
    cut = F.percentile_approx("perplexity", quantile, ACCURACY)
    overall = trusted.agg(cut).first()[0]
    own = trusted.groupBy("lang").agg(cut.alias("own"))
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    return rows.join(own.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "lang", "perplexity", threshold.alias("threshold"), F.coalesce("trusted", F.lit(False)).alias("trusted"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))

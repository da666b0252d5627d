"""Audit of how document filters interact.

Five filters look at a whole text; a row's failures are one number with a bit for each filter.
Four follow from the row alone.  The fifth, a copy of an earlier text, is an existential self-join:
a left-semi join on hash, exact text and smaller doc_id marks the copies, whose ids are put in a
union with the ids of the other failures.  Everything the audit reports for any order of the filters
follows from the numbers of rows for each combination of bits.

The side of the join that is looked up has one row for each text, its smallest id, a partial
aggregate: no two rows of a group of copies are paired.  A hash that many rows share is salted; the
number of such hashes is bounded by the size of a hot group.  Only texts whose hash occurs twice
are shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from seriesmill.llm.common import FILE, ROW, stored, with_row_keys
from seriesmill.session import bounded_broadcast

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
# What separates words, what marks junk, the limits of the four filters.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
# Rows of one hash that go to one task; a hash with more is hot if it also holds more than one row in
# HOT_SHARE, so that there are never more hot hashes than that.
HOT_ROWS, HOT_SHARE = 256, 10_000


def row_failures(text: Column) -> Column:
    """Bits of the filters A to D, from the text alone."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    # One evaluation of the words for the two filters that count them.
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    bit = lambda name, fails: F.when(fails, 1 << FILTERS.index(name)).otherwise(0)
    few = F.transform(F.array(counted), lambda c: bit("A", c["all"] < LEAST_WORDS)
                      .bitwiseOR(bit("B", 100 * c["distinct"] < LEAST_DISTINCT * c["all"])))[0]
    return few.bitwiseOR(bit("C", 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text))).bitwiseOR(
        bit("D", text.rlike(SYMBOLS)))


def copies(keyed: DataFrame, narrow: DataFrame) -> DataFrame:
    """(FILE, ROW) of rows whose text is also that of a row with a smaller doc_id.

    keyed: FILE, ROW, doc_id, text, hash; narrow: the same without the text, stored.  A row without an
    id is neither a copy nor an original.
    """
    repeated = stored(narrow.where("doc_id is not null").groupBy("hash").agg(
        F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"), F.max("doc_id").alias("largest"),
    ).where("least < largest").select("hash", "rows"), "repeated")
    total = repeated.agg(F.sum("rows")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = repeated.where(F.col("rows") > limit).select("hash", F.ceil(F.col("rows") / limit).cast("int").alias("salts"))
    hot = F.broadcast(hot)  # at most HOT_SHARE rows

    salts = F.coalesce("salts", F.lit(1))
    every = F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    salted = repeated.join(hot, "hash", "left").select("hash", every)
    rows = keyed.where("doc_id is not null").join(hot, "hash", "left").withColumn(
        "salt", F.pmod(F.xxhash64(FILE, ROW), salts).cast("int")).drop("salts")
    rows = rows.join(bounded_broadcast(salted), ["hash", "salt"], "left_semi")
    originals = keyed.where("doc_id is not null").join(
        bounded_broadcast(repeated.select("hash")), "hash", "left_semi").groupBy("hash", "text").agg(F.min("doc_id").alias("original"))
    originals = originals.join(hot, "hash", "left").select("hash", "text", "original", every)
    earlier = originals.select(F.col("hash").alias("h"), F.col("salt").alias("s"), F.col("text").alias("t"), "original")
    same = (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s")) & (F.col("text") == F.col("t"))
    return rows.join(earlier, same & (F.col("original") < F.col("doc_id")), "left_semi").select(FILE, ROW)


def failures(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang",
    quality: str = "quality", toxic: str = "toxic",
) -> DataFrame:
    """One row per document: FILE, ROW, doc_id, part, good, toxic, failing (bits of FILTERS).

    A null text is empty, a null part the empty string.  good and toxic say whether any label of the
    doc_id does; repeated labels count once, unlabelled rows and rows without an id are neither.
    """
    keyed = with_row_keys(docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text")))
    keyed = keyed.withColumn("hash", F.xxhash64("text"))
    marked = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.coalesce(F.max(F.col(quality) == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col(toxic) == 1), F.lit(False)).alias("toxic"))
    narrow = stored(keyed.select(FILE, ROW, "doc_id", "part", "hash", row_failures(F.col("text")).alias("bits")), "failures")
    copied = copies(keyed, narrow.select(FILE, ROW, "doc_id", "hash"))
    one = F.lit(None)
    ids = narrow.select(FILE, ROW, "doc_id", "part", "bits").unionByName(
        copied.select(FILE, ROW, one.cast(narrow.schema["doc_id"].dataType).alias("doc_id"), one.cast("string").alias("part"),
                      F.lit(COPY).alias("bits")))
    failing = ids.groupBy(FILE, ROW).agg(
        F.max("doc_id").alias("doc_id"), F.max("part").alias("part"), F.bit_or("bits").alias("failing"))
    said = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return failing.join(bounded_broadcast(marked), "doc_id", "left").select(
        FILE, ROW, "doc_id", "part", said("good"), said("toxic"), "failing")


def interactions(failing: DataFrame) -> DataFrame:
    """What each filter does at each step of every order, for each part.

    From part, good, toxic, failing: one row per part, filter_order (all permutations of FILTERS) and
    step (from 1) with kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.  Rows
    are counted, repeated ones too.  An empty table has no part and gives an empty result.
    """
    combined = failing.groupBy("part", "failing").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))).alias("filter_order")
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    # 32 combinations at most in a part, each at 600 steps.
    lined = combined.select("*", orders).select("*", steps)
    bits = lambda letters: sum(
        (F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), start=F.lit(0))
    lined = lined.withColumns({
        "own": bits(F.substring("filter_order", F.col("step"), F.lit(1))),
        "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    fails = F.col("failing").bitwiseAND(F.col("own")) != 0
    gone = F.col("failing").bitwiseAND(F.col("before")) != 0
    removed = fails & ~gone
    total = lambda condition, column="n": F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))
    counted = lined.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~gone).alias("kept"), total(removed).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("failing") == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"))
    shares = counted.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return counted.join(shares, ["part", "own"]).drop("own")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """`interactions` of the failures of all documents; see there and `failures` for special cases."""
    return interactions(failures(docs, labels, **columns))

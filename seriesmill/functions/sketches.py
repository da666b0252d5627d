"""Quantile sketches with a bound on the relative error, built from plain aggregates.

With g = (1 + e) / (1 - e), a value x other than 0 falls into bucket ceil(log_g |x|) of its side
(-1, 0 or 1), and the bucket's middle 2 g^i / (g + 1) differs from x by at most the share e.  Side and
bucket are one number that sorts like the values.

Long form: one row per group and bucket with the number of values, merged by addition.  It is what
streams and rollups count.  Packed form: one struct per group with its level and its buckets in the
order of their values.  Where a group has more than `limit` buckets, neighbours are joined (i becomes
ceil(i / 2), g becomes g^2) until it has not; the level says how often.  The level of a group is the
smallest that fits and joining twice is joining by four, so packing parts and merging them gives the
same struct as packing the whole.  NULL, NaN and infinite values are not counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Error of a value before buckets are joined, buckets of a packed state.
ERROR, LIMIT = 0.001, 100
# After so many joins all doubles of a side share two buckets.
LEVELS = 20
BUCKET, COUNT = "bucket", "n"
PACKED = "struct<level:int,buckets:array<struct<bucket:bigint,n:bigint>>>"
_SHIFT = 40


def log_base(error: float = ERROR) -> float:
    return math.log((1 + error) / (1 - error))


def _coded(side: Column, index: Column) -> Column:
    return side * F.lit(1 << _SHIFT) + side * index


def _side(bucket: Column) -> Column:
    return F.shiftright(bucket + F.lit(1 << _SHIFT - 1), _SHIFT)


def _index(bucket: Column) -> Column:
    side = _side(bucket)
    return side * (bucket - side * F.lit(1 << _SHIFT))


def bucket(value: Column, error: float = ERROR) -> Column:
    """Bucket of a value; NULL for what is not counted."""
    v = value.cast("double")
    index = F.ceil(F.ln(F.abs(v)) / F.lit(log_base(error))).cast("long")
    coded = F.when(v == 0, F.lit(0).cast("long")).otherwise(_coded(F.signum(v).cast("long"), index))
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), coded)


def bucket_counts(df: DataFrame, keys: Sequence[Column | str], value: str, error: float = ERROR) -> DataFrame:
    """Long form: keys, bucket, n."""
    counted = df.groupBy(*keys, bucket(F.col(value), error).alias(BUCKET)).agg(F.count(F.lit(1)).alias(COUNT))
    return counted.where(F.col(BUCKET).isNotNull())


def _joined(bucket: Column, steps: Column) -> Column:
    """The bucket after `steps` joins."""
    return _coded(_side(bucket), F.ceil(_index(bucket) / F.pow(F.lit(2.0), steps)).cast("long"))


def _pack(held: Column, level: Column, limit: int | None) -> Column:
    """Packed struct of an array of (bucket, n) at a common level; buckets may repeat."""
    def after(steps):
        return F.array_distinct(F.transform(held, lambda b: _joined(b[BUCKET], steps)))

    if limit is None:
        steps = F.lit(0)
    else:
        fits = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.size(after(k)) <= limit)
        steps = F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(LEVELS))

    def build(chosen):
        moved = F.transform(held, lambda b: F.struct(_joined(b[BUCKET], chosen).alias(BUCKET), b[COUNT].alias(COUNT)))
        total = lambda p: F.aggregate(
            F.filter(moved, lambda b: b[BUCKET] == p), F.lit(0).cast("long"), lambda n, b: n + b[COUNT])
        counts = F.transform(F.array_sort(after(chosen)), lambda p: F.struct(p.alias(BUCKET), total(p).alias(COUNT)))
        return F.struct((level + chosen).cast("int").alias("level"), counts.alias("buckets"))

    # The number of joins is worked out once for a group.
    return F.transform(F.array(steps), build)[0].cast(PACKED)


def packed(limit: int | None = LIMIT) -> Column:
    """Aggregate over the rows of a group in long form: its packed sketch."""
    held = F.collect_list(F.when(F.col(BUCKET).isNotNull(), F.struct(BUCKET, COUNT)))
    return _pack(held, F.lit(0), limit)


def pack(counts: DataFrame, keys: Sequence[str], name: str = "sketch", limit: int | None = LIMIT) -> DataFrame:
    """One packed sketch per group of a long form, in which a bucket may have several rows."""
    summed = counts.groupBy(*keys, BUCKET).agg(F.sum(COUNT).alias(COUNT))
    return summed.groupBy(*keys).agg(packed(limit).alias(name))


def merge(sketch: str, limit: int | None = LIMIT) -> Column:
    """Aggregate: one packed sketch of many."""
    states = F.collect_list(F.col(sketch))
    level = F.coalesce(F.array_max(F.transform(states, lambda s: s["level"])), F.lit(0))
    held = F.flatten(F.transform(states, lambda s: F.transform(s["buckets"], lambda b: F.struct(
        _joined(b[BUCKET], level - s["level"]).alias(BUCKET), b[COUNT].alias(COUNT)))))
    return _pack(held, level, limit)


def count(sketch: str) -> Column:
    return F.aggregate(F.col(f"{sketch}.buckets"), F.lit(0).cast("long"), lambda n, b: n + b[COUNT])


def bound(sketch: str, error: float = ERROR) -> Column:
    """Largest relative error of a value read from the sketch."""
    return F.tanh(F.lit(log_base(error)) * F.pow(F.lit(2.0), F.col(f"{sketch}.level")) / 2)


def quantile(sketch: str, q: float, error: float = ERROR) -> Column:
    """The value of rank floor(q (n - 1)), counted from 0, within the bound; NULL for an empty sketch."""
    rank = F.floor(F.lit(float(q)) * (count(sketch) - 1))
    base = F.lit(log_base(error)) * F.pow(F.lit(2.0), F.col(f"{sketch}.level"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("found"))

    def step(a, b):
        upto = a["seen"] + b[COUNT]
        here = a["found"].isNull() & (upto > rank)
        return F.struct(upto.alias("seen"), F.when(here, b[BUCKET]).otherwise(a["found"]).alias("found"))

    def middle(a):
        side = _side(a["found"])
        size = F.lit(2.0) * F.exp((_index(a["found"]) - 1) * base) / (F.exp(-base) + 1)
        return F.when(side == 0, F.lit(0.0)).otherwise(side * size)

    return F.aggregate(F.col(f"{sketch}.buckets"), start, step, middle)

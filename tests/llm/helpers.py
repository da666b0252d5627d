"""Small frames with the awkward cases that every operator has to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple], extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text[, lang, source]) rows, with extra columns of clashing names."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s0")), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return df


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

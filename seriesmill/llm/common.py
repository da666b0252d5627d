"""What the text operators share: row identity, stored intermediates, the fold of a row."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesmill.session import scratch_path

# A row of a file scan is named by its file and its place there.
FILE, ROW = "__file", "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends here, and every
    later evaluation sees the same rows in the same files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_keys(df: DataFrame) -> DataFrame:
    """Adds (FILE, ROW), the same on every evaluation.

    A plain file scan has them for free; any other frame is written once first, because the
    order of its rows may differ from one evaluation to the next.
    """
    try:
        if "_metadata" in df.columns:
            raise ValueError("a user's column hides the file metadata")
        keyed = df.select("*", "_metadata.file_path", "_metadata.row_index")
    except (AnalysisException, ValueError):
        hidden = [F.col(f"`{c}`").alias("__metadata" if c == "_metadata" else c) for c in df.columns]
        keyed = stored(df.select(*hidden)).select("*", "_metadata.file_path", "_metadata.row_index")
        keyed = keyed.withColumnRenamed("__metadata", "_metadata")
    return keyed.select(
        *(keyed[f"`{c}`"] for c in df.columns),
        F.xxhash64(keyed["file_path"]).alias(FILE),
        keyed["row_index"].alias(ROW),
    )


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """`docs` with columns named __0, __1, ... so that none clashes with a column of ours, and the new
    names of the given columns.  `docs.columns` gives the old names back."""
    return docs.toDF(*(f"__{i}" for i in range(len(docs.columns)))), [f"__{docs.columns.index(n)}" for n in names]


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)))


def fold(doc_id: str, folds: int = 5) -> Column:
    """crc32 of the id as text modulo `folds`; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds

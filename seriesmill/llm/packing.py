"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens.  In each round a queue is granted its quantum (its target share
of a window) and serves the whole tokens of its deficit; the rest is carried to the next round.
After r rounds a queue has served min(total, floor(r * quantum)) tokens, so the deficit at any
round is known without running the rounds before it: every task computes where its own documents
fall, deficits carry over windows and partitions by that formula, and no state is passed along.
Windows are consecutive stretches of the served tokens, full but for the last one.

Tokens are counted and written once; the second pass reads them with the start of each
(partition, queue) and cuts each document where a round or a window ends.

Every source has a queue, however many there are.  Up to QUEUES of them, each task adds up what all
queues serve in the rounds of its documents.  With more, totals and quanta are a table joined by
source; documents are cut where a block of BLOCK rounds ends, the pieces of a block meet in one
group, and a running sum over the blocks' tokens says where each begins.  Both give the same places.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from seriesmill.llm.bytelevel import ByteLevel
from seriesmill.llm.common import stored
from seriesmill.llm.memo import slices, spans
from seriesmill.session import bounded_broadcast, scratch_path

WINDOW = 2048
END_ID = 1
# Quanta are whole multiples of 1 / UNIT token: all arithmetic is exact in 64 bits.
UNIT = 1 << 16
# With more sources than this, queues are rows of a table instead of arrays in every task.
QUEUES = 255
# Rounds whose pieces are put in order together, and blocks whose tokens are summed together.
BLOCK, BLOCKS = 128, 1 << 16
SLICE_BYTES = 4 << 20


def tokenised(docs: DataFrame, tokenizer: str, queue_of: Mapping[str | None, int] | None, text: str, doc_id: str, source: str) -> DataFrame:
    """doc_id, part, queue, within (tokens of the queue before it in its part), doc_tokens, ids,
    source.  Without `queue_of` the sources of each part are numbered anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteLevel(tokenizer)
        kind = np.dtype("<u2") if encoder.size <= 1 << 16 else np.dtype("<u4")
        part, numbers, filled = TaskContext.get().partitionId(), dict(queue_of or {}), defaultdict(int)
        for batch in batches:
            names, texts = batch.column("source").to_pylist(), batch.column("text")
            for start, end in slices(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
                rows = {"within": [], "queue": [], "doc_tokens": [], "ids": []}
                for name, content in zip(names[start:end], texts.slice(start, end - start).to_pylist(), strict=True):
                    ids = np.append(encoder.ids(content), END_ID).astype(kind)
                    queue = numbers[name] if queue_of else numbers.setdefault(name, len(numbers))
                    rows["queue"].append(queue)
                    rows["within"].append(filled[queue])
                    rows["doc_tokens"].append(len(ids))
                    rows["ids"].append(ids.tobytes())
                    filled[queue] += len(ids)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, end - start),
                    pa.array(np.full(end - start, part), pa.int64()), pa.array(rows["queue"], pa.int32()),
                    pa.array(rows["within"], pa.int64()), pa.array(rows["doc_tokens"], pa.int64()),
                    pa.array(rows["ids"], pa.binary()), batch.column("source").slice(start, end - start),
                ], names=["doc_id", "part", "queue", "within", "doc_tokens", "ids", "source"])

    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, part long, queue int, within long, doc_tokens long, ids binary, source string")


def turns(quantum: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of queue tokens, cut where a round ends: (row, first token, end, round)."""
    round_of = lambda token, quantum: -(-(token + 1) * UNIT // quantum) - 1
    first = round_of(start, quantum)
    # A quantum below one token serves single tokens, each in a round of its own.
    single = quantum < UNIT
    count = np.where(single, length, round_of(start + length - 1, quantum) - first + 1)
    row = np.repeat(np.arange(len(quantum)), count)
    nth = spans(np.zeros(len(count), np.int64), count)
    quantum, token = quantum[row], start[row] + nth
    turn = np.where(single[row], round_of(token, quantum), first[row] + nth)
    low = np.where(single[row], token, np.maximum(start[row], turn * quantum // UNIT))
    high = np.where(single[row], token + 1, np.minimum((start + length)[row], (turn + 1) * quantum // UNIT))
    return row, low, high, turn


def window_cuts(place: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Stretches of served tokens, cut at the ends of windows: (row, first place, end)."""
    cuts = (place + size - 1) // window - place // window + 1
    row = np.repeat(np.arange(len(place)), cuts)
    edge = (place[row] // window + spans(np.zeros(len(cuts), np.int64), cuts)) * window
    return row, np.maximum(place[row], edge), np.minimum(place[row] + size[row], edge + window)


class Rounds:
    """Where the tokens of each queue lie in the served order."""

    def __init__(self, totals: list[int], quanta: list[int], window: int):
        self.totals, self.quanta, self.window = np.array(totals, np.int64), np.array(quanta, np.int64), window

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens served of each queue (columns) before each round (rows)."""
        return np.minimum(self.totals, rounds[:, None] * self.quanta // UNIT)

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """For documents at `start` of their queues: (row, start in the document, length, position)."""
        row, low, high, turn = turns(self.quanta[queue], start, length)
        q = queue[row]
        distinct, at = np.unique(turn, return_inverse=True)
        before, after = self.served(distinct), self.served(distinct + 1)
        ahead = np.cumsum(after - before, axis=1) - (after - before)
        place = before.sum(axis=1)[at] + ahead[at, q] + low - turn * self.quanta[q] // UNIT
        piece, left, right = window_cuts(place, high - low, self.window)
        row = row[piece]
        return row, low[piece] + left - place[piece] - start[row], right - left, left


def _schema(tokens: DataFrame) -> str:
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _flat(ids: pa.Array, length: np.ndarray) -> np.ndarray:
    raw = b"".join(ids.to_pylist())
    return np.frombuffer(raw, f"<u{len(raw) // max(1, int(length.sum()))}").astype("<u4")


def _pieces(
    doc_id: pa.Array, start: np.ndarray, size: np.ndarray, doc_tokens: np.ndarray, place: np.ndarray, window: int, ids: np.ndarray,
) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int64)
    return pa.RecordBatch.from_arrays([
        doc_id, pa.array(start), pa.array(size), pa.array(doc_tokens), pa.array(place // window), pa.array(place % window),
        pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary()),
    ], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def _queues(ends: DataFrame, window: int, targets: Mapping[str, float] | None) -> DataFrame:
    """source, queue (its place in a round, the source of most rows first) and quantum."""
    totals = stored(ends.groupBy("source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "sources")
    whole = max(1, totals.agg(F.sum("n")).first()[0])
    if targets:
        # The given targets are an argument, so a table of them is small.
        given = totals.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "name string, target double")
        totals = totals.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        got = totals.agg(F.sum(F.when(F.col("target").isNull(), F.col("n"))).alias("rest"), F.collect_list("target").alias("targets")).first()
        share = math.fsum(got["targets"]) + (got["rest"] or 0) / whole
        quantum = F.bround(F.coalesce("target", F.col("n") / F.lit(float(whole))) * float(window * UNIT) / F.lit(share)).cast("long")
    else:
        quantum = F.expr(f"(cast(n as decimal(20, 0)) * {window * UNIT} + {whole - 1}) div {whole}").cast("long")
    ordered = totals.withColumn("quantum", F.greatest(F.lit(1).cast("long"), quantum)).orderBy(F.desc("docs"), "source")
    return stored(ordered.select("source", "quantum", F.monotonically_increasing_id().alias("queue")), "queues")


def _by_blocks(tokens: DataFrame, window: int, targets: Mapping[str, float] | None) -> DataFrame:
    """The pieces of `pack` for any number of sources."""
    ends = stored(tokens.groupBy("part", F.col("queue").alias("local"), "source").agg(
        F.sum("doc_tokens").alias("n"), F.count(F.lit(1)).alias("docs")), "ends")
    queues = _queues(ends, window, targets)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("part", "local", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    named = bounded_broadcast(queues.withColumnRenamed("source", "name"))
    starts = stored(starts.join(named, F.col("source").eqNullSafe(F.col("name"))).select("part", "local", "before", "queue", "quantum"), "starts")
    placed = tokens.withColumnRenamed("queue", "local").join(bounded_broadcast(starts), ["part", "local"]).select(
        "doc_id", "queue", "quantum", "doc_tokens", "ids", (F.col("before") + F.col("within")).alias("at"))

    def numbers(rows: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
        return [rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(rows, pa.RecordBatch)
                else rows.column(c).to_numpy().astype(np.int64) for c in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column("doc_tokens").to_pylist(), SLICE_BYTES // 2):
                quantum, at, length = numbers(batch.slice(low, high - low), "quantum", "at", "doc_tokens")
                _, begin, end, block = turns(quantum * BLOCK, at, length)
                names, which = np.unique(block, return_inverse=True)
                held = np.zeros(len(names), np.int64)
                np.add.at(held, which, end - begin)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(held)], names=["block", "n"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False)
            for low, high in slices(sizes, SLICE_BYTES):
                rows = batch.slice(low, high - low)
                quantum, at, length = numbers(rows, "quantum", "at", "doc_tokens")
                row, begin, end, block = turns(quantum * BLOCK, at, length)
                raw = b"".join(rows.column("ids").to_pylist())
                width = len(raw) // max(1, int(length.sum()))
                # Fragments follow each other in the order of the documents.
                offsets = np.concatenate([[0], np.cumsum((end - begin) * width)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id").take(pa.array(row)), rows.column("queue").take(pa.array(row)), pa.array(quantum[row]),
                    pa.array(length[row]), pa.array(begin), pa.array(begin - at[row]), pa.array(end - begin), pa.array(block),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary()),
                ], names=["doc_id", "queue", "quantum", "doc_tokens", "at", "start", "length", "block", "ids"])

    # Tokens before each block: sums within BLOCKS blocks, then of those.
    held = placed.select("quantum", "at", "doc_tokens").mapInArrow(count, "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    held = stored(held.withColumn("many", F.floor(F.col("block") / BLOCKS)), "blocks")
    before = lambda *keys: Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    above = held.groupBy("many").agg(F.sum("n").alias("n")).withColumnRenamed("many", "block")
    above = above.select(F.col("block").alias("many"), F.coalesce(F.sum("n").over(before()), F.lit(0)).alias("above"))
    bases = held.join(above, "many").select(
        "block", (F.col("above") + F.coalesce(F.sum("n").over(before("many")), F.lit(0))).alias("base"))

    def serve(rows: pa.Table) -> pa.Table:
        queue, quantum, tokens_of, at, start, length, base = numbers(
            rows, "queue", "quantum", "doc_tokens", "at", "start", "length", "base")
        row, low, high, turn = turns(quantum, at, length)
        order = np.lexsort((low, queue[row], turn))
        row, low, size = row[order], low[order], (high - low)[order]
        place = base[0] + np.cumsum(size) - size
        piece, left, right = window_cuts(place, size, window)
        row, begin, size = row[piece], low[piece] + left - place[piece], right - left
        first = np.cumsum(length) - length
        ids = _flat(rows.column("ids"), length)[spans(first[row] + begin - at[row], size)]
        doc_id = rows.column("doc_id").combine_chunks().take(pa.array(row))
        return pa.Table.from_batches([_pieces(doc_id, start[row] + begin - at[row], size, tokens_of[row], left, window, ids)])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    fragments = placed.mapInArrow(
        split, f"doc_id {kind}, queue long, quantum long, doc_tokens long, at long, start long, length long, block long, ids binary")
    return fragments.join(bounded_broadcast(stored(bases, "bases")), "block").groupBy("block").applyInArrow(serve, _schema(tokens))


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, targets: Mapping[str, float] | None = None,
    text: str = "text", doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids are the piece's tokens as little-endian unsigned 32-bit numbers.  targets: share of a window
    by source; the default is each source's share of all tokens, which fills every window alike to
    the end.  A queue that runs out leaves its share
    to the others.  Every token of every row lies in exactly one piece.  A null text is the empty
    text (one end token), a null source is a source of its own; repeated rows and equal ids are packed
    one by one; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    names = [r["source"] for r in sizes.orderBy(F.desc("n"), "source").limit(QUEUES + 1).collect()]
    many = len(names) > QUEUES
    path = scratch_path(spark, "tokens")
    tokens = tokenised(docs, tokenizer, None if many else {s: i for i, s in enumerate(names)}, text, doc_id, source)
    tokens.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(tokens.schema).parquet(path)
    if many:
        return _by_blocks(tokens, window, targets)

    ends = tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("queue", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    totals = [0] * len(names)
    for r in ends.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # one row per queue
        totals[r["queue"]] = r["n"]
    whole = max(1, sum(totals))
    share = [targets[s] if targets and s in targets else n / whole for s, n in zip(names, totals, strict=True)]
    if targets:
        quanta = [max(1, round(window * UNIT * x / sum(share))) for x in share]
    else:
        quanta = [max(1, -(-window * UNIT * n // whole)) for n in totals]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(totals, quanta, window)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False)
            for low, high in slices(sizes, SLICE_BYTES):
                rows = batch.slice(low, high - low)
                queue, at, length = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("queue", "at", "doc_tokens"))
                row, start, size, place = rounds.pieces(queue, at, length)
                # Pieces follow each other in the order of the documents, so they share one buffer.
                ids = _flat(rows.column("ids"), length)
                yield _pieces(rows.column("doc_id").take(pa.array(row)), start, size, length[row], place, window, ids)

    placed = tokens.join(bounded_broadcast(starts), ["queue", "part"]).select("doc_id", "queue", "doc_tokens", "ids", (F.col("before") + F.col("within")).alias("at"))
    return placed.mapInArrow(run, _schema(tokens))

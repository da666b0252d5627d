"""Language identification with mixtures of languages.

A language is a distribution over buckets of character trigrams within words, counted over all
learnt documents and smoothed towards that of all languages.  A text is a mixture: expectation
maximisation estimates the share of each language from the likelihoods of its trigrams.  The set of
languages is the one with the largest penalised likelihood among the nested sets that remain when
the smallest share is dropped again and again; a text whose best single language is within one
penalty of the whole mixture needs no search, as no larger set can win.

Overlapping trigrams are not independent: likelihoods count 1 / SIZE.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seriesmill.llm.common import FILE, ROW, fold, with_row_keys
from seriesmill.llm.memo import slices

SIZE, BUCKETS = 3, 1 << 16
# Weight of the smoothing distribution, in trigrams.
PRIOR = 500.0
# Cost of one more language: this times the logarithm of the number of trigrams.
PENALTY = 4.0
ROUNDS, STEP_ROUNDS, STILL = 30, 12, 1e-3
UNKNOWN = "und"
# The model is sent to every task, BUCKETS floats for each language: at most 256 MB.
MOST_LANGUAGES = 512
# Characters taken at a time (for four languages; fewer where more are told apart), and the languages
# whose counts a task holds.
SLICE, HELD_LANGUAGES = 1 << 20, 64
_end = re.compile(r"[\x00-@\[-`{-\x7f]")


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every trigram around a letter, words being bounded on both sides."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\0".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    value = np.where(letters()[points], points, 0).astype(np.uint64)
    at = np.nonzero(value)[0]  # never first or last
    mixed = value[at - 1] * np.uint64(0x9E3779B97F4A7C15) + value[at] * np.uint64(0xC2B2AE3D27D4EB4F) + value[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return text[at - 1], (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS


def pieces(texts: list[str], limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of about `limit` characters; a longer text is cut where a word has surely ended."""
    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while start < len(text):
            cut = _end.search(text, start + limit) if len(text) - start > limit else None
            stop = cut.start() if cut else len(text)
            owners.append(i)
            held.append(text[start:stop])
            size, start = size + stop - start, stop
            if size >= limit:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def counted(texts: list[str], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count), sorted, of the trigrams of whole texts."""
    keys, counts = [], []
    for owners, held in pieces(texts, limit):
        text, bucket = trigrams(held)
        key, count = np.unique(np.array(owners, np.int64)[text] * BUCKETS + bucket, return_counts=True)
        keys.append(key)
        counts.append(count)
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key // BUCKETS, key % BUCKETS, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for low, high in slices(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), limit):
            part = batch.slice(low, high - low)
            yield part, part.column("text").to_pylist()


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the probability of each bucket in each, from all rows of (text, lang), both not null.

    A language needs a text with a letter.  More than MOST_LANGUAGES raise a ValueError.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, count in held.items():
                own = np.nonzero(count)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own), pa.array(count[own])], names=["lang", "bucket", "n"])
            held.clear()

        for part, texts in _texts(batches, SLICE):
            text, bucket, count = counted(texts, SLICE)
            lang = np.array(part.column("lang").to_pylist(), object)[text]
            for name in set(lang):
                if len(held) >= HELD_LANGUAGES and name not in held:
                    yield from out()
                own = lang == name
                held[name] = held.get(name, 0) + np.bincount(bucket[own], count[own], BUCKETS).astype(np.int64)
        yield from out()

    counts = rows.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # A row for each language, of BUCKETS numbers at most.
    found = counts.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list(F.col("n").cast("double")).alias("counts"))
    found = found.limit(MOST_LANGUAGES + 1).toArrow()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = found.column("lang").to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    seen = np.zeros((len(names), BUCKETS))
    for place, i in enumerate(order):
        seen[place, found.column("buckets")[i].values.to_numpy()] = found.column("counts")[i].values.to_numpy()
    return [names[i] for i in order], smoothed(seen)


def smoothed(seen: np.ndarray) -> np.ndarray:
    whole = seen.sum(axis=0) + 1.0 / BUCKETS
    return ((seen + PRIOR * whole / whole.sum()) / (seen.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32)


class Mixtures:
    """Trigram counts of some texts, each with at least one, and mixtures fitted to them."""

    def __init__(self, text: np.ndarray, bucket: np.ndarray, count: np.ndarray, model: np.ndarray):
        self.starts = np.nonzero(np.diff(text, prepend=-1))[0]
        self.sizes = np.diff(self.starts, append=len(text))
        self.at = np.repeat(np.arange(len(self.starts)), self.sizes)
        self.likely, self.count = model[:, bucket], count.astype(np.float32)
        self.total = np.add.reduceat(count, self.starts).astype(np.float64)
        self.text, self.bucket, self.model = text, bucket, model

    def some(self, chosen: np.ndarray) -> Mixtures:
        rows = chosen[self.at]
        return Mixtures(self.text[rows], self.bucket[rows], self.count[rows], self.model)

    def single(self) -> np.ndarray:
        """Log-likelihood of each text in each language alone."""
        return np.add.reduceat((np.log(self.likely) * self.count).astype(np.float64), self.starts, axis=1) / SIZE

    def fit(self, share: np.ndarray, rounds: int) -> np.ndarray:
        """Shares (language, text) after expectation maximisation; a share of 0 remains 0."""
        for _ in range(rounds):
            part = share.astype(np.float32)[:, self.at] * self.likely
            part *= self.count / part.sum(axis=0)
            after = np.add.reduceat(part, self.starts, axis=1, dtype=np.float64) / self.total
            after /= after.sum(axis=0)
            moved, share = np.abs(after - share).max(initial=0), after
            if moved < STILL:
                break
        return share

    def likelihood(self, share: np.ndarray) -> np.ndarray:
        mixed = (share.astype(np.float32)[:, self.at] * self.likely).sum(axis=0)
        return np.add.reduceat((np.log(mixed) * self.count).astype(np.float64), self.starts) / SIZE

    def chosen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares of the chosen set, its penalised likelihood, that of every single language."""
        single = self.single()
        number, cost = len(single), PENALTY * np.log1p(self.total)
        best, texts = single.max(axis=0), np.arange(len(self.starts))
        share = np.zeros_like(single)
        share[single.argmax(axis=0), texts] = 1.0
        if number > 1:
            mixed = self.fit(np.full_like(single, 1.0 / number), ROUNDS)
            open_ = self.likelihood(mixed) - best > cost
            if open_.any():
                share[:, open_], best[open_] = self.some(open_).search(mixed[:, open_], cost[open_], share[:, open_], best[open_])
        return share, best, single

    def search(self, mixed: np.ndarray, cost: np.ndarray, share: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best of the nested sets, from all languages down to two, and the given single one."""
        texts = np.arange(len(cost))
        for number in range(len(mixed), 1, -1):
            value = self.likelihood(mixed) - (number - 1) * cost
            better = value > best
            share, best = np.where(better, mixed, share), np.where(better, value, best)
            least = np.where(mixed > 0, mixed, np.inf).argmin(axis=0)
            mixed = mixed.copy()
            mixed[least, texts] = 0.0
            left = mixed.sum(axis=0)
            # All shares but one may have vanished already.
            mixed = np.where(left > 0, mixed / np.where(left > 0, left, 1), share)
            mixed = self.fit(mixed, STEP_ROUNDS)
        return share, best


def identify(texts: list[str | None], languages: list[str], model: np.ndarray) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """(language, score, shares) of every text."""
    found: list = [(UNKNOWN, 0.0, [])] * len(texts)
    text, bucket, count = counted([t or "" for t in texts], SLICE)
    if not languages or not len(text):
        return found
    share, best, single = Mixtures(text, bucket, count, model).chosen()
    first, places = share.argmax(axis=0), np.unique(text)
    others = single.copy()
    others[first, np.arange(len(first))] = -np.inf
    # The chosen set against the best single language without the first.
    certain = 1 / (1 + np.exp(np.clip(others.max(axis=0) - best, -50, 50)))
    for k, place in enumerate(places):
        own = sorted(((-share[i, k], languages[i]) for i in np.nonzero(share[:, k])[0]))
        found[place] = (languages[first[k]], float(share[first[k], k] * certain[k]), [(name, float(-s)) for s, name in own])
    return found


def classify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """One row per document: FILE, ROW, doc_id, held_out, lang_pred, score, shares (language, share; largest first).

    Learnt from rows with a text and a language outside the held-out fold of the doc_id; a row without
    an id is neither learnt from nor held out.  lang_pred has the largest share in the chosen set, of
    equal ones the first by name.  A null text, one without a letter and every text of a table without
    anything to learn is UNKNOWN with score 0.  Repeated rows count as often as they are there; long
    texts are read whole, in pieces; other columns are ignored; an empty table gives an empty result.
    """
    keyed = with_row_keys(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")))
    held_out = F.coalesce(fold("doc_id") == 0, F.lit(False))
    taught = keyed.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id") != 0))
    given = keyed.sparkSession.sparkContext.broadcast(learn(taught))
    limit = SLICE * 4 // max(4, len(given.value[0]))
    columns = [FILE, ROW, "doc_id", "held_out"]
    shares = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, limit):
            found = identify(texts, *given.value)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in columns), pa.array([f[0] for f in found]), pa.array([f[1] for f in found]),
                 pa.array([[{"lang": n, "share": s} for n, s in f[2]] for f in found], shares)],
                names=[*columns, "lang_pred", "score", "shares"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.select(FILE, ROW, "doc_id", held_out.alias("held_out"), "text").mapInArrow(
        run, f"{FILE} long, {ROW} long, doc_id {kind}, held_out boolean, lang_pred string, score double, "
        "shares array<struct<lang string, share double>>")

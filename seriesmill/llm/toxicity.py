"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are two: an embedding of the whole word and the mean of embeddings of its
character 3- to 5-grams, both hashed.  A text is cut into overlapping windows of words; the network
reads each window in both directions, pools the states by attention and gives one logit.  The
score of a text comes from its largest window logit, so every window of every text is scored.

Training sees only whether a text is toxic, not where: the windows of a text share one logit by
log-sum-exp, which lets the gradient find the telling ones.  It uses a bounded sample of labelled
rows of any length (see `sample`) and of long texts some passages (see `excerpt`); scale and shift
are fitted on the sample's whole texts; everything else runs over all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seriesmill.llm.common import FILE, ROW, fold, restored, set_aside, stored, with_row_keys
from seriesmill.llm.memo import slices, spans

WINDOW, STEP = 32, 24
WORDS, GRAMS = 1 << 15, 1 << 16  # rows of the two embedding tables
WORD_DIM, GRAM_DIM, HIDDEN = 8, 16, 8
GRAM_SIZES = (3, 4, 5)
# The sample: at most so many clean and toxic rows; of longer texts passages of about so many characters.
TRAIN_ROWS, TRAIN_CHARS = (4000, 2000), 3000
# Small samples are read more often, in smaller batches, so that the steps suffice.
LEAST_TEXTS = 3
EPOCHS, STEPS, BATCH, LEAST_BATCH, RATE = 4, 300, 48, 8, 0.01
SLICE_BYTES, SCORED_AT_ONCE, ENTRIES, HASHED_AT_ONCE = 2 << 20, 2048, 250_000, 16_384
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the word table, rows of the gram table of all words in turn, and the grams' counts."""
    marked = [f"<{w.strip(_EDGE) or w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = spans(np.zeros(len(sizes), np.int64), sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max(initial=1)), 1_000_003, np.uint64))
        word = _mix(np.add.reduceat(points * power[place], starts)) % np.uint64(WORDS)
        grams, owners = [], []
        until = np.repeat(ends, sizes) - np.arange(len(points))  # characters left in the word
        owner = np.repeat(np.arange(len(words)), sizes)
        for n in GRAM_SIZES:
            at = np.nonzero(until >= n)[0]
            value = np.full(len(at), n, np.uint64)
            for k in range(n):
                value = value * np.uint64(0x100000001B3) + points[at + k]
            grams.append(_mix(value) % np.uint64(GRAMS))
            owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return word.astype(np.int32), np.concatenate(grams)[order].astype(np.int32), counts.astype(np.int32)


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`features` of any number of words: they are hashed in slices, as the steps of that take many times their room."""
    parts = [features(words[i:i + HASHED_AT_ONCE]) for i in range(0, len(words), HASHED_AT_ONCE)]
    word, grams, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
    return word, grams, counts.astype(np.int64)


def gram_means(table: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(counts), table.shape[1]), np.float32)
    some = counts > 0
    if len(grams):
        sums[some] = np.add.reduceat(table[grams], (np.cumsum(counts) - counts)[some], axis=0)
    return sums / np.maximum(counts, 1)[:, None].astype(np.float32)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of these lengths laid end to end: text, first word, words in the window.
    Every text has one window at least, each but the last full."""
    count = np.maximum(1, -(-(lengths - WINDOW) // STEP) + 1)
    text = np.repeat(np.arange(len(lengths)), count)
    begin = spans(np.zeros(len(count), np.int64), count) * STEP
    ends = np.cumsum(lengths)
    return text, (ends - lengths)[text] + begin, np.minimum(WINDOW, lengths[text] - begin)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def new(seed: int = 7) -> Network:
        random = np.random.default_rng(seed)
        make = lambda *shape, by=1.0: (random.standard_normal(shape) * by).astype(np.float32)
        wide = WORD_DIM + GRAM_DIM
        return Network({
            "word": make(WORDS, WORD_DIM, by=0.05), "gram": make(GRAMS, GRAM_DIM, by=0.2),
            "input": make(wide, 6 * HIDDEN, by=wide**-0.5), "bias": np.zeros(6 * HIDDEN, np.float32),
            "forward": make(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), "backward": make(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5),
            "attention": make(2 * HIDDEN, by=0.3), "out": make(2 * HIDDEN, by=0.3), "out_bias": np.full(1, -2, np.float32),
        })

    def inputs(self, word: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.concatenate([self.weights["word"][word], gram_means(self.weights["gram"], grams, counts)], axis=1)

    def gates(self, inputs: np.ndarray) -> list[np.ndarray]:
        both = inputs @ self.weights["input"] + self.weights["bias"]
        return [np.ascontiguousarray(both[:, :3 * HIDDEN]), np.ascontiguousarray(both[:, 3 * HIDDEN:])]

    def run(self, gates: list[np.ndarray], at: np.ndarray, size: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows: gates has a row per word for each direction, at (windows x WINDOW)
        names the rows."""
        n, h = len(at), HIDDEN
        steps = int(size.max(initial=1))
        states = np.zeros((steps, n, 2 * h), np.float32)
        for side, recurrent in enumerate((self.weights["forward"], self.weights["backward"])):
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                x = gates[side][at[:, t]]
                u = state @ recurrent
                zr = sigmoid(x[:, :2 * h] + u[:, :2 * h])
                new = np.tanh(x[:, 2 * h:] + zr[:, h:] * u[:, 2 * h:])
                z = zr[:, :h]
                after = (new + z * (state - new)) * (t < size)[:, None]
                if keep is not None:
                    keep.append((side, t, state, zr, new, u[:, 2 * h:]))
                state = after
                states[t, :, side * h:(side + 1) * h] = state
        scores = states @ self.weights["attention"]
        scores[np.arange(steps)[:, None] >= size] = -1e9
        share = np.exp(scores - scores.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", share, states)
        logits = pooled @ self.weights["out"] + self.weights["out_bias"][0]
        if keep is not None:
            keep.append((states, share, pooled))
        return np.where(size > 0, logits, np.float32(-20))

    def back(self, keep: list, at: np.ndarray, size: np.ndarray, d_logits: np.ndarray, rows: int) -> dict[str, np.ndarray]:
        """Gradients of the dense weights and of the gates (key "gates")."""
        h, w = HIDDEN, self.weights
        states, share, pooled = keep.pop()
        d_logits = np.where(size > 0, d_logits, 0).astype(np.float32)
        g = {"out": d_logits @ pooled, "out_bias": d_logits.sum(keepdims=True)}
        d_pooled = d_logits[:, None] * w["out"]
        d_share = np.einsum("nd,tnd->tn", d_pooled, states)
        d_scores = share * (d_share - (share * d_share).sum(axis=0))
        g["attention"] = np.einsum("tn,tnd->d", d_scores, states)
        d_states = share[:, :, None] * d_pooled + d_scores[:, :, None] * w["attention"]
        n, steps = len(at), len(states)
        d_gates = np.zeros((steps, n, 6 * h), np.float32)
        g["forward"], g["backward"] = np.zeros_like(w["forward"]), np.zeros_like(w["backward"])
        carry = np.zeros((n, h), np.float32)
        for side, t, state, zr, new, un in reversed(keep):
            if t == (steps - 1 if side == 0 else 0):
                carry = np.zeros((n, h), np.float32)
            recurrent, name = (w["forward"], "forward") if side == 0 else (w["backward"], "backward")
            d = (carry + d_states[t, :, side * h:(side + 1) * h]) * (t < size)[:, None]
            z, r = zr[:, :h], zr[:, h:]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (state - new) * z * (1 - z)
            d_r = d_new * un * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_gates[t, :, side * 3 * h:(side + 1) * 3 * h] = np.concatenate([d_z, d_r, d_new], axis=1)
            g[name] += state.T @ d_u
            carry = d * z + d_u @ recurrent.T
        flat = np.zeros((rows, 6 * h), np.float32)
        order = np.argsort(at[:, :steps].T.ravel(), kind="stable")
        names, first = np.unique(at[:, :steps].T.ravel()[order], return_index=True)
        flat[names] = np.add.reduceat(d_gates.reshape(-1, 6 * h)[order], first, axis=0)
        g["gates"] = flat
        return g


def window_rows(begin: np.ndarray, size: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Names of the words in each window; places beyond its end repeat its last word."""
    at = begin[:, None] + np.minimum(np.arange(WINDOW), np.maximum(size - 1, 0)[:, None])
    return words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else np.zeros(at.shape, np.int64)


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Network:
    """`learnt`, with scale and shift from a logistic fit of the training texts' largest window logits."""
    network = learnt(texts, toxic, seed)
    return calibrated(network, Scorer(network).logits(texts), np.array(toxic, np.float32))


def learnt(texts: list[str], toxic: list[int], seed: int = 7) -> Network:
    """Adam on the dense weights, AdaGrad on the embedding rows; scale and shift are left as they are."""
    network, random = Network.new(seed), np.random.default_rng(seed)
    w = network.weights
    vocabulary: dict[str, int] = {}
    common: dict[str, np.ndarray] = {}
    coded = [np.array([vocabulary.setdefault(x, len(vocabulary)) for x in words_of(t)], np.int32) for t in texts]
    word, grams, counts = features_of(list(vocabulary) or [""])
    del vocabulary
    first = np.cumsum(counts) - counts
    # Rows of the tables that few texts use could only learn those texts by heart: they stay zero.
    for table, rows in (("word", lambda i: word[i]), ("gram", lambda i: grams[spans(first[i], counts[i])])):
        seen = np.zeros(len(w[table]), np.int64)
        for i in coded:
            seen[np.unique(rows(np.unique(i)))] += 1
        w[table][seen < LEAST_TEXTS] = 0
        common[table] = seen >= LEAST_TEXTS
    target = np.array(toxic, np.float32)
    dense = ["input", "bias", "forward", "backward", "attention", "out", "out_bias"]
    moments = {k: (np.zeros_like(w[k]), np.zeros_like(w[k])) for k in dense}
    squares = {k: np.full(w[k].shape, 1e-3, np.float32) for k in ("word", "gram")}
    tick, batch = 0, min(BATCH, max(LEAST_BATCH, len(texts) // 40))
    for _ in range(max(EPOCHS, -(-STEPS * batch // len(texts)))):
        order = random.permutation(len(texts))
        for start in range(0, len(order), batch):
            chosen = order[start:start + batch]
            lengths = np.array([len(coded[i]) for i in chosen], np.int64)
            used, names = np.unique(np.concatenate([coded[i] for i in chosen]), return_inverse=True)
            if not len(used):
                continue
            mine = spans(first[used], counts[used])
            x = network.inputs(word[used], grams[mine], counts[used])
            text, begin, size = windows(lengths)
            at, keep = window_rows(begin, size, names), []
            logits = network.run(network.gates(x), at, size, keep)
            edges = np.concatenate([[0], np.nonzero(np.diff(text))[0] + 1])
            top = np.maximum.reduceat(logits, edges)
            share = np.exp(logits - top[text])
            total = np.add.reduceat(share, edges)
            whole = top + np.log(total)
            d = (sigmoid(whole) - target[chosen]) * np.where(target[chosen] > 0, 2, 1) / len(chosen)
            g = network.back(keep, at, size, d[text] * share / total[text], len(used))
            d_gates = g.pop("gates")
            g["input"], g["bias"] = x.T @ d_gates, d_gates.sum(axis=0)
            d_x = d_gates @ w["input"].T
            tick += 1
            for k in dense:
                m, v = moments[k]
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] * g[k] - v)
                w[k] -= RATE * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.999**tick)) + 1e-8)
            each = (d_x[:, WORD_DIM:] / np.maximum(counts[used], 1)[:, None])[np.repeat(np.arange(len(used)), counts[used])]
            for k, rows, values in (("word", word[used], d_x[:, :WORD_DIM]), ("gram", grams[mine], each)):
                names, at_row = np.unique(rows, return_inverse=True)
                order_row = np.argsort(at_row, kind="stable")
                sums = np.add.reduceat(values[order_row], np.concatenate([[0], np.nonzero(np.diff(at_row[order_row]))[0] + 1]), axis=0)
                names, sums = names[common[k][names]], sums[common[k][names]]
                squares[k][names] += sums * sums
                w[k][names] -= 0.1 * sums / np.sqrt(squares[k][names])
    return network


def calibrated(network: Network, top: np.ndarray, target: np.ndarray) -> Network:
    """`network` with the scale and shift that fit the largest logits of texts."""
    top, scale, shift = top.astype(np.float64), 1.0, 0.0
    for _ in range(400):  # gradient steps of a two-parameter logistic fit, lightly damped
        p = sigmoid(scale * top + shift)
        error = (p - target) * np.where(target > 0, (target == 0).sum() / max(1, target.sum()), 1)
        scale -= 0.02 * ((error * top).mean() + 0.01 * (scale - 1))
        shift -= 0.1 * error.mean()
    network.scale, network.shift = float(max(scale, 1e-3)), float(shift)
    return network


class Scorer:
    """Scores texts; gates of words already seen are remembered."""

    def __init__(self, network: Network):
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = [np.zeros((1 << 12, 3 * HIDDEN), np.float32) for _ in range(2)]

    def remember(self, words: set[str]) -> None:
        if len(self.known) + len(words) > ENTRIES:
            self.clear()
        fresh = [x for x in words if x not in self.known]
        if not fresh:
            return
        size = len(self.known)
        while size + len(fresh) > len(self.table[0]):
            self.table = [np.concatenate([t, np.zeros_like(t)]) for t in self.table]
        inputs = [self.network.inputs(*features(fresh[i:i + HASHED_AT_ONCE])) for i in range(0, len(fresh), HASHED_AT_ONCE)]
        for table, gates in zip(self.table, self.network.gates(np.concatenate(inputs)), strict=True):
            table[size:size + len(fresh)] = gates
        self.known.update(zip(fresh, range(size, size + len(fresh)), strict=True))

    def logits(self, texts: list[str]) -> np.ndarray:
        """Largest window logit of each text; all its windows count."""
        best = np.full(len(texts), -np.inf, np.float32)
        for low, high in slices(map(len, texts), SLICE_BYTES):
            split = [words_of(t) for t in texts[low:high]]
            self.remember(set().union(*split))
            lengths = np.array([len(s) for s in split], np.int64)
            names = np.fromiter((self.known[x] for s in split for x in s), np.int64, int(lengths.sum()))
            text, begin, size = windows(lengths)
            for start in range(0, len(text), SCORED_AT_ONCE):
                some = slice(start, start + SCORED_AT_ONCE)
                got = self.network.run(self.table, window_rows(begin[some], size[some], names), size[some])
                np.maximum.at(best, low + text[some], got)
        return best

    def scores(self, texts: list[str]) -> np.ndarray:
        """Logits count to three decimals: their last digits depend on the rows read along with a text."""
        return sigmoid(self.network.scale * self.logits(texts).astype(np.float64).round(3) + self.network.shift)


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """draw, doc_id, text, toxic: at most TRAIN_ROWS labelled rows outside the held-out fold, chosen by a
    hash of the id among all labelled ids that have a row with text.  Of repeated ids one row is
    taken.  A label without a value is no label, and a toxic label outweighs others of the same id."""
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).where(fold(doc_id) != 0)
    known = known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    keyed = with_row_keys(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).where(F.length("text") > 0)
    # Ids are made distinct before they meet their labels, so that no repeated id is a hot key.
    there = keyed.groupBy("doc_id").agg(F.min(F.struct(FILE, ROW)).alias("at"))
    there = stored(there.join(known, "doc_id").withColumn("draw", F.xxhash64("doc_id")), "labelled")
    drawn = [there.where(F.col("toxic") == k).orderBy("draw", "doc_id").limit(TRAIN_ROWS[k]) for k in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1]).select("draw", "toxic", F.col(f"at.{FILE}").alias(FILE), F.col(f"at.{ROW}").alias(ROW))
    return stored(keyed.join(F.broadcast(drawn), [FILE, ROW]).select("draw", "doc_id", "text", "toxic"), "sample")


def excerpt(text: str, seed: int) -> str:
    """A text of TRAIN_CHARS characters or less whole; of a longer one passages of WINDOW words, drawn
    from all of it by the seed, in their order."""
    if len(text) <= TRAIN_CHARS:
        return text
    words = text.split()
    passages = [" ".join(w[:TRAIN_CHARS] for w in words[i:i + WINDOW])[:TRAIN_CHARS] for i in range(0, len(words), WINDOW)]
    chosen, held = [], 0
    for i in np.random.default_rng(seed).permutation(len(passages)):
        if held >= TRAIN_CHARS:
            break
        chosen.append(i)
        held += len(passages[i])
    return " ".join(passages[i] for i in sorted(chosen))


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> Network | None:
    """The network, trained in one task on the bounded sample, or None where the labelled texts are
    of one class only."""
    rows = sample(docs, labels, **columns)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column("draw").to_pylist()
            short = [excerpt(t.as_py(), seed & (1 << 63) - 1) for t, seed in zip(batch.column("text"), seeds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("draw"), batch.column("doc_id"), pa.array(short, pa.string()), batch.column("toxic")],
                names=["draw", "doc_id", "text", "toxic"])

    # As many rows as TRAIN_ROWS allows, none above twice TRAIN_CHARS characters.
    short = rows.mapInArrow(shorten, f"draw long, doc_id {kind}, text string, toxic int").collect()
    found = sorted((r["toxic"], r["draw"], r["doc_id"], r["text"]) for r in short)
    texts, toxic = [r[3] for r in found], [r[0] for r in found]
    if len(set(toxic)) < 2:
        return None
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((texts, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learnt(*given.value))], pa.binary())], names=["network"])

    network = pickle.loads(spark.range(1, numPartitions=1).mapInArrow(run, "network binary").first()[0])
    model = spark.sparkContext.broadcast(network)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([
                    batch.column("draw").slice(low, high - low), batch.column("toxic").slice(low, high - low),
                    pa.array(scorer.logits(texts.slice(low, high - low).to_pylist()), pa.float32()),
                ], names=["draw", "toxic", "top"])

    tops = sorted(tuple(r) for r in rows.mapInArrow(measure, "draw long, toxic int, top float").collect())
    return calibrated(network, np.array([r[2] for r in tops]), np.array([r[1] for r in tops], np.float32))


def score(docs: DataFrame, network: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and score (0 to 1) of every row.

    A null text counts as empty; an empty text has the score of a window without words.  Without a
    network every score is 0.  Repeated rows are scored one by one; other columns are ignored and
    are no input of the score; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(network)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value) if model.value is not None else None
        for batch in batches:
            texts = batch.column(len(keep))
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for low, high in slices(sizes, SLICE_BYTES):
                some = texts.slice(low, high - low).to_pylist()
                values = scorer.scores(some) if scorer else np.zeros(high - low)
                columns = [batch.column(i).slice(low, high - low) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.float64())], names=[*keep, "score"])

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(text), F.lit("")).alias("__scored_text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, score double")


def keep_clean(docs: DataFrame, network: Network | None, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of `docs` with a score below `limit`, with their columns."""
    inner, (text,) = set_aside(docs, text)
    return restored(score(inner, network, text, tuple(inner.columns)).where(F.col("score") < limit), docs)

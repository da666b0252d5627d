import random

import numpy as np
import pytest
from helpers import documents

from seriesmill.llm import toxicity


@pytest.fixture(scope="module")
def taught():
    """Texts of invented words; toxic ones hold some words with one of two stems, about as many as
    toxic texts of the test tables do."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choices(["er", "th", "on", "ing", "st", "a", "re"], k=draw.randint(1, 4)))

    def text(toxic):
        words = [word() for _ in range(draw.randint(5, 120))]
        for _ in range(5 * toxic):
            words.insert(draw.randint(0, len(words)), draw.choice(["zumk", "quib"]) + word())
        return " ".join(words)

    labels = [int(draw.random() < 0.3) for _ in range(700)]
    texts = [text(t) for t in labels]
    return toxicity.train(texts[:500], labels[:500]), texts, labels, text


def test_held_out_accuracy(taught):
    network, texts, labels, _ = taught
    predicted = toxicity.Scorer(network).scores(texts[500:]) >= 0.5
    assert (predicted == np.array(labels[500:])).mean() > 0.93


def test_every_window_of_a_long_text_counts(taught):
    network, _, _, text = taught
    scorer, clean = toxicity.Scorer(network), [text(0) for _ in range(60)]
    alone = scorer.logits(clean)
    together = scorer.logits([" ".join(clean[:30]), " ".join(clean[30:] + ["zumkerth"])])
    assert together[1] > together[0] and together[1] > alone.max() - 3


def test_gradients():
    toxicity_network, draw = toxicity.Network.new(), np.random.default_rng(1)
    toxicity_network.weights = {k: v.astype(np.float64) for k, v in toxicity_network.weights.items()}
    gates = [draw.standard_normal((6, 3 * toxicity.HIDDEN)) for _ in range(2)]
    at, size = draw.integers(0, 6, (4, toxicity.WINDOW)), np.array([5, toxicity.WINDOW, 1, 9])
    weight, keep = draw.standard_normal(4), []
    loss = lambda: float(weight @ toxicity_network.run(gates, at, size))
    toxicity_network.run(gates, at, size, keep)
    found = toxicity_network.back(keep, at, size, weight, 6)
    for name in ("forward", "backward", "attention", "out", "out_bias"):
        array = toxicity_network.weights[name].reshape(-1)
        for i in draw.integers(0, len(array), 4):
            kept = array[i]
            array[i] = kept + 0.01
            up = loss()
            array[i] = kept - 0.01
            down = loss()
            array[i] = kept
            assert abs((up - down) / 0.02 - found[name].reshape(-1)[i]) < 0.02 * (1 + abs(found[name].reshape(-1)[i]))
    for side in range(2):
        for i, j in draw.integers(0, 6, (4, 2)):
            gates[side][i, j] += 0.01
            up = loss()
            gates[side][i, j] -= 0.02
            down = loss()
            gates[side][i, j] += 0.01
            want = found["gates"][i, side * 3 * toxicity.HIDDEN + j]
            assert abs((up - down) / 0.02 - want) < 0.02 * (1 + abs(want))


def test_windows_cover_every_word():
    lengths = np.array([0, 1, 31, 32, 33, 56, 57, 500])
    text, begin, size = toxicity.windows(lengths)
    starts = np.cumsum(lengths) - lengths
    for i, n in enumerate(lengths):
        covered = {w for b, s in zip(begin[text == i], size[text == i], strict=True) for w in range(b, b + s)}
        assert covered == set(range(starts[i], starts[i] + n)) and (text == i).any()


def test_operator(spark, taught):
    network, texts, labels, _ = taught
    rows = [(i, t) for i, t in enumerate(texts[:300])] + [(900, None), (901, ""), (902, " \n"), (None, texts[0]), (0, texts[0])]
    docs = documents(spark, rows, ("score", "held_out", "toxic"))
    given = spark.createDataFrame([(i, y) for i, y in enumerate(labels[:300])] + [(None, 1), (3, None), (0, labels[0])], "doc_id long, toxic int")
    model = toxicity.fit(docs, given.withColumnRenamed("toxic", "toxic"))
    got = {}
    for r in toxicity.score(docs, model).collect():
        assert got.setdefault(r.doc_id, r.score) == r.score and 0 <= r.score <= 1
    assert got[900] == got[901] == got[902] and len(got) == 304
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, s in got.items() if s < 0.5}


def test_long_labelled_texts_are_learnt_from(spark, taught, monkeypatch):
    _, texts, labels, text = taught
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 300)
    draw = random.Random(3)
    long = {i: " ".join(text(y) for _ in range(8)) for i, y in enumerate(draw.choices([0, 1], k=200))}
    toxic = {i: int("zumk" in t or "quib" in t) for i, t in long.items()}
    assert min(map(len, long.values())) > 300
    model = toxicity.fit(documents(spark, list(long.items())), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    assert model is not None
    got = toxicity.Scorer(model).scores(list(long.values())) >= 0.5
    assert (got == np.array([toxic[i] for i in long])).mean() > 0.9


def test_the_sample_is_drawn_among_rows_that_are_there(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", (6, 3))
    # Most labelled ids have no row or no text, and one id fills half of the table.
    rows = [(i, f"text {i}") for i in range(960, 1000)] + [(1, "")] + [(960, f"copy {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1000)], "doc_id long, toxic int")
    got = toxicity.sample(documents(spark, rows), labels).collect()
    assert sorted(r.toxic for r in got) == [0] * 6 + [1] * 3
    assert len({r.doc_id for r in got}) == 9


def test_excerpts_are_bounded():
    words = [f"w{i}" for i in range(5000)]
    short = toxicity.excerpt(" ".join(words), 5)
    assert toxicity.TRAIN_CHARS <= len(short) <= 2 * toxicity.TRAIN_CHARS + 100
    at = [int(w[1:]) for w in short.split()]
    assert at == sorted(set(at)) and at[-1] - at[0] > 2500
    assert len(toxicity.excerpt("x" * 100_000, 5)) <= toxicity.TRAIN_CHARS


def test_one_class_and_empty(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(documents(spark, []), toxicity.Network.new()).count() == 0


def plain_logit(network, words):
    """One window of one text, word by word."""
    w, h = network.weights, toxicity.HIDDEN
    if not words:
        return -20.0
    x = [np.concatenate([w["word"][rows], w["gram"][grams].mean(axis=0, keepdims=True)], axis=1)[0].astype(np.float64)
         for rows, grams, _ in (toxicity.features([word]) for word in words)]
    states = np.zeros((len(words), 2 * h))
    for side, (name, order) in enumerate((("forward", range(len(words))), ("backward", range(len(words) - 1, -1, -1)))):
        state = np.zeros(h)
        for t in order:
            gate = x[t] @ w["input"][:, side * 3 * h:(side + 1) * 3 * h] + w["bias"][side * 3 * h:(side + 1) * 3 * h]
            u = state @ w[name]
            z, r = (1 / (1 + np.exp(-(gate[k * h:(k + 1) * h] + u[k * h:(k + 1) * h]))) for k in (0, 1))
            new = np.tanh(gate[2 * h:] + r * u[2 * h:])
            state = (1 - z) * new + z * state
            states[t, side * h:(side + 1) * h] = state
    score = states @ w["attention"]
    share = np.exp(score - score.max())
    return float(share / share.sum() @ states @ w["out"] + w["out_bias"][0])


def test_scores_against_a_plain_loop_over_windows(taught):
    network, texts, _, text = taught
    some = [*texts[:12], " ".join(text(k % 2) for k in range(4)), "", "one", " ".join(texts[:2])]
    for got, t in zip(toxicity.Scorer(network).logits(some), some, strict=True):
        words, tops = toxicity.words_of(t), []
        for start in range(0, max(1, len(words)), toxicity.STEP):
            tops.append(plain_logit(network, words[start:start + toxicity.WINDOW]))
            if start + toxicity.WINDOW >= len(words):
                break
        assert abs(got - max(tops)) < 2e-3


def test_passages_across_window_edges(taught):
    """Passages of 10 to 32 words with five telling ones, at every offset to the windows of a long clean text."""
    network, _, _, text = taught
    draw, scorer = random.Random(4), toxicity.Scorer(network)
    clean = [t for t in (text(0) for _ in range(200)) if scorer.scores([t])[0] < 0.5]
    words = " ".join(clean).split()[:400]
    assert scorer.scores([" ".join(words)])[0] < 0.5
    found = []
    for size in (10, 16, 24, 32):
        for offset in range(toxicity.STEP):
            passage = words[:size]
            for place in draw.sample(range(size), 5):
                passage[place] = draw.choice(["zumk", "quib"]) + draw.choice(["er", "th", "ing", "sta", "re"])
            at = 4 * toxicity.STEP + offset
            found.append(scorer.scores([" ".join(words[:at] + passage + words[at:])])[0] >= 0.5)
    assert np.mean(found) > 0.9


def test_hashing_many_words_takes_little_room():
    """Words are hashed in slices: the same rows, without the steps of all words at a time."""
    import tracemalloc

    draw = random.Random(4)
    words = ["".join(draw.choices("abcdeé", k=draw.randint(1, 14))) for _ in range(60_000)]
    room = {}
    for f in (toxicity.features, toxicity.features_of):
        tracemalloc.start()
        found = f(words)
        room[f.__name__] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        if f is toxicity.features:
            want = found
    assert all(np.array_equal(a, b) for a, b in zip(found, want, strict=True))
    assert room["features_of"] < 0.7 * room["features"]

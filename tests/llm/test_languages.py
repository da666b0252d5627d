import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F
from test_queries import FOLDER

from seriesmill.llm import languages
from seriesmill.llm.registered import QUERIES

WORDS = {
    "en": "the of and then there with that this have from shall would which were their been".split(),
    "de": "der die und nicht auch für über ein einer schon haben werden wird zwischen".split(),
    "fr": "le la les une des être avec dans pour qui que nous vous où était".split(),
    "ru": "это что как так все она был быть который если только".split(),
}


def text(draw, lang, n=80):
    return " ".join(draw.choices(WORDS[lang], k=n))


def corpus(n=240):
    draw = random.Random(2)
    return [(i, text(draw, lang, draw.choice([3, 30, 200])), lang, "s") for i, lang in enumerate(draw.choices(sorted(WORDS), k=n))]


def plain_counts(t):
    """Trigrams around every letter, words bounded on both sides."""
    marked = "\0" + "".join(c if c.isalpha() else "\0" for c in t.lower()) + "\0"
    return Counter(marked[k - 1:k + 2] for k in range(1, len(marked) - 1) if marked[k] != "\0")


def test_trigrams_against_plain_counts(monkeypatch):
    monkeypatch.setattr(languages, "SLICE", 50)
    draw = random.Random(1)
    texts = ["".join(draw.choices("abÉ東 .\n1'", k=draw.randint(0, 90))) for _ in range(60)] + ["", "...", "a", "x" * 300]
    at, bucket, count = languages.counted(texts, 50)
    for i, t in enumerate(texts):
        want = Counter()
        for gram, n in plain_counts(t).items():
            want[int(languages.trigrams([gram[1]])[1][0]) if gram == f"\0{gram[1]}\0" else gram] += n
        mine = at == i
        assert count[mine].sum() == sum(want.values()) and mine.sum() <= len(want)
        for gram in want:
            if isinstance(gram, int):
                assert count[mine & (bucket == gram)].sum() >= want[gram]


def test_expectation_maximisation_against_a_plain_loop():
    draw = np.random.default_rng(3)
    model = languages.smoothed(draw.integers(0, 50, (3, languages.BUCKETS)) * (draw.random((3, languages.BUCKETS)) < 0.01) * 1.0)
    grams = [draw.choice(languages.BUCKETS, 200, p=np.array(model[k % 3], float) / model[k % 3].astype(float).sum()) for k in range(7)]
    grams[3] = np.concatenate([grams[0], grams[1]])
    rows = [(i, b, n) for i, g in enumerate(grams) for b, n in sorted(Counter(g.tolist()).items())]
    at, bucket, count = (np.array(c) for c in zip(*rows, strict=True))
    fitted = languages.Mixtures(at, bucket, count, model)
    got = fitted.fit(np.full((3, 7), 1 / 3), languages.ROUNDS)
    for i, g in enumerate(grams):
        share = [1 / 3] * 3
        for _ in range(languages.ROUNDS):
            hold = [0.0] * 3
            for b in g:
                part = [s * float(model[k, b]) for k, s in enumerate(share)]
                hold = [h + p / sum(part) for h, p in zip(hold, part, strict=True)]
            share = [h / len(g) for h in hold]
        assert np.allclose(got[:, i], share, atol=0.02)
        loss = sum(math.log(sum(got[k, i] * float(model[k, b]) for k in range(3))) for b in g) / languages.SIZE
        assert math.isclose(fitted.likelihood(got)[i], loss, rel_tol=1e-4)
    share, _, _ = fitted.chosen()
    assert (share > 0).sum(axis=0).tolist() == [1, 1, 1, 2, 1, 1, 1]


def test_languages_and_their_shares(spark):
    draw = random.Random(8)
    rows = corpus()
    held = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 5 == 0]
    mixed = [(held[0], text(draw, "en", 300) + ". " + text(draw, "fr", 100), None, "s"), (held[1], text(draw, "ru", 50), "de", "s"),
             (held[2], "über", None, "s"), (held[3], text(draw, "de", 150_000), None, "s")]
    odd = [(held[4], None, "en", "s"), (held[5], "12 ... !", "en", "s"), (held[6], "", "en", "s"), (None, text(draw, "fr", 9), "fr", "s")]
    docs = documents(spark, [*rows, rows[0], *mixed, *odd], ("held_out", "shares", "score", "lang_pred"))
    found = languages.classify(docs).collect()
    assert len(found) == len(rows) + 1 + len(mixed) + len(odd)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == lang for i, _, lang, _ in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    both = by_id[held[0]]
    assert [s.lang for s in both.shares] == ["en", "fr"] and 0.6 < both.shares[0].share < 0.85 and 0.6 < both.score < 0.85
    assert [by_id[held[k]].lang_pred for k in (1, 2, 3)] == ["ru", "de", "de"]
    assert all(by_id[held[k]].lang_pred == languages.UNKNOWN and by_id[held[k]].score == 0 for k in (4, 5, 6))
    assert by_id[None].lang_pred == "fr" and all(0 <= r.score <= 1 for r in found)


def test_held_out_languages_are_never_looked_at(spark):
    rows = corpus(120)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    lied = [(i, t, "xx" if fold(i) == 0 else lang, s) for i, t, lang, s in rows]
    take = lambda docs: sorted((r.doc_id, r.lang_pred, r.score) for r in languages.classify(docs).collect())
    assert take(documents(spark, rows)) == take(documents(spark, lied))


def test_nothing_to_learn(spark):
    assert languages.classify(documents(spark, [])).count() == 0
    rows = [(1, "some text", None, "s"), (2, None, "en", "s"), (3, "...", "de", "s")]
    assert {r.lang_pred for r in languages.classify(documents(spark, rows)).collect()} == {languages.UNKNOWN}


def test_more_languages_than_a_model_holds_are_refused(spark, monkeypatch):
    monkeypatch.setattr(languages, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        languages.classify(documents(spark, corpus(60)))


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_query(spark):
    found = QUERIES["op13_language_id"](spark, str(FOLDER)).join(
        spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95

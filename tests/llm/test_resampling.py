import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F
from test_queries import FOLDER

from seriesmill.llm import resampling
from seriesmill.llm.registered import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[k:k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def expected(rows, target, longest=1, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, runs(text, longest)[1]))
    for text in target:
        t.update(map(bucket, runs(text, longest)[1]))
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    out = []
    for place, (doc_id, text) in enumerate(rows):
        words, own = runs(text, longest)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None, len(words), place])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, r in enumerate(order[:percent * len(order) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(found):
    return sorted(map(tuple, found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def sample():
    draw = random.Random(9)
    words = ["Lorem", "ipsum", "É", "é", "9to5", "x_y", "don't", "東京", "a`b", "\x7f", "İ", "퟿", "🎉", "no\x00pe"]
    rows = [(i, draw.choice([" ", "\n", "--"]).join(draw.choices(words, k=draw.choice([0, 1, 19, 20, 40, 90])))) for i in range(120)]
    rows += [(None, rows[4][1]), (None, rows[4][1]), rows[5], rows[5], (500, None), (501, ""), (502, "ab " * 200_000)]
    return rows, ["lorem ipsum " * 5, None, "", "é 東京 9to5"]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_against_brute_force(spark, longest):
    rows, target = sample()
    docs = documents(spark, rows, ("n_words", "score", "rank", "buckets", "__task"))
    found = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest_run=longest, percent=40)
    assert rows_of(found) == expected(rows, target, longest, percent=40)


def test_pieces_of_a_long_text_are_its_words(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 10)
    text = "Alpha beta-GAMMA 12 é" * 30 + "x" * 50 + " y"
    reader = resampling.Features(2, 10_000)
    assert reader.words(text) == runs(text, 1)[0]
    assert reader.of(text)[1].tolist() == [zlib.crc32(f.encode()) % 10_000 for f in runs(text, 2)[1]]


def test_ranks_over_many_tasks(spark):
    """One score for all rows: ranges cut between rows of one score."""
    rows = spark.range(0, 5000, numPartitions=7).select(
        F.lit(1).cast("long").alias(resampling.FILE), F.col("id").alias(resampling.ROW),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 1000).cast("long").alias("doc_id"), F.lit(7).cast("long").alias("score"))
    got = resampling.ranked(rows, 100).collect()
    order = sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r[resampling.ROW]))
    assert [r["rank"] for r in order] == list(range(1, 5001))


def test_empty(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(documents(spark, []), none).count() == 0
    assert rows_of(resampling.resample(documents(spark, [(1, "a b")]), none)) == expected([(1, "a b")], [])


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_query(spark):
    db = duckdb.connect()
    rows = db.execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    target = [t for (t,) in db.execute(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    want = expected(rows, target)
    assert rows_of(QUERIES["op12_importance_resampling"](spark, str(FOLDER))) == want
    assert sum(r[4] is not None for r in want) > 5 and np.std([r[2] for r in want]) > 0

"""The registered queries over whole test tables: against their SQL, or against brute force."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from seriesmill.llm import credentials
from seriesmill.llm.registered import ORACLE, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in ("documents", "conversations", "embeddings", "labels", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, db, name):
    got, want = QUERIES[name](spark, str(FOLDER)).toPandas(), db.execute(ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda frame: sorted(map(tuple, frame[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_tokens(spark, db):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for doc_id, text in db.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids = library.encode(text)
        want[doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op2_piece_tokens"](spark, str(FOLDER)).collect()} == want


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline(spark, db):
    """Each stage keeps what its rule says of its own input, and its decisions take effect."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, states = docs.columns, [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(FOLDER)), name)
        assert docs.columns == columns
        states.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(states[-1])
    start, clean, single, apart, masked = states
    toxic = {i for (i,) in db.execute("SELECT doc_id FROM labels WHERE toxic = 1").fetchall()}
    good = {i for (i,) in db.execute("SELECT doc_id FROM labels WHERE toxic = 0").fetchall()}
    assert set(clean) <= set(start) and len(good & set(clean)) > 0.9 * len(good) and len(toxic & set(clean)) < len(toxic) / 2

    largest = {}
    for i, r in clean.items():
        largest[r.text] = max(i, largest.get(r.text, -1))
    assert set(single) == set(largest.values())

    sets = {}
    for i, r in single.items():
        words = r.text.split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(apart) == {find(i) for i in sets}
    assert set(masked) == set(apart)
    for i, r in masked.items():
        assert r.text == apart[i].text or (credentials.MASK in r.text and r.n_chars == len(r.text))

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(FOLDER)).toPandas()
    for doc_id, mine in pieces.groupby("doc_id"):
        ids = np.array([*library.encode(masked[doc_id].text, add_special_tokens=False).ids, 1], "<u4")
        assert zlib.crc32(b"".join(map(bytes, mine.sort_values("start")["ids"]))) == zlib.crc32(ids.tobytes())
    assert set(pieces["doc_id"]) == set(masked)

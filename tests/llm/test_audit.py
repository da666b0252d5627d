import random
import re
from itertools import permutations

from helpers import documents
from pyspark.sql import functions as F

from seriesmill.llm import audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """Failing filters of every (doc_id, text, part), one after the other."""
    out = []
    for doc_id, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        bad += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        bad += "E" * any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        out.append((doc_id, part or "", bad))
    return out


def expected(rows, good, toxic):
    failed, out = fails(rows), []
    for part in {p for _, p, _ in failed}:
        mine, removed_by = [(i, b) for i, p, b in failed if p == part], dict.fromkeys(audit.FILTERS, 0)
        lines = []
        for order in map("".join, permutations(audit.FILTERS)):
            alive = mine
            for step, name in enumerate(order, 1):
                removed = [(i, b) for i, b in alive if name in b]
                gone = [i for i, b in mine if name in b and (i, b) not in alive]
                alive = [(i, b) for i, b in alive if name not in b]
                removed_by[name] += len(removed)
                lines.append([part, order, step, len(alive), len(removed), len(gone), sum(b == name for _, b in mine),
                              sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), name])
        out += [tuple([*line[:-1], removed_by[line[-1]]]) for line in lines]
    return sorted(out)


def sample(n=150):
    draw = random.Random(4)
    words = ["lorem", "ipsum", "A", "BCD", "x#", "é", " ", "a|b", "no break"]
    texts = [" ".join(draw.choices(words, k=draw.choice([0, 3, 199, 200, 210]))) for _ in range(25)]
    texts += [" ".join(f"w{k}" for k in range(n)) for n in (199, 200, 400)] + [None, "", "\t\x0b\x0c\x1c"]
    rows = [(i, draw.choice(texts), draw.choice(["en", "de", None, ""])) for i in range(n)]
    return rows + [rows[3], rows[3], (None, rows[0][1], "en"), (None, None, None), (5000, "word " * 60_000, "en")]


def run(spark, rows, labels, extra=()):
    docs = documents(spark, [(i, t, p, "s") for i, t, p in rows], extra)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("failing", F.lit(1))
    return docs, marks


def test_against_brute_force(spark):
    rows = sample()
    labels = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1), (3, None, 0), (9, None, None), (None, 1, 1), (7777, 1, 1)]
    labels += [(i, i % 2, i % 3) for i in range(20, 90)]
    docs, marks = run(spark, rows, labels, ("part", "failing", "hash", "salt"))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    # Rows of one id, or without one, would be one row to the plain loop; there is none among the labelled.
    got = audit.failures(docs, marks)
    want = sorted((repr(i), p, b) for i, p, b in fails(rows))
    letters = lambda bits: "".join(f for k, f in enumerate(audit.FILTERS) if bits >> k & 1)
    assert sorted((repr(r.doc_id), r.part, letters(r.failing)) for r in got.collect()) == want

    distinct = [r for k, r in enumerate(rows) if r[0] is not None and r not in rows[:k]]
    docs, marks = run(spark, distinct, labels)
    table = audit.audit(docs, marks)
    assert sorted(map(tuple, table.select(*COLUMNS).collect())) == expected(distinct, good, toxic)


def test_hot_hash_is_salted_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(audit, "HOT_ROWS", 4)
    monkeypatch.setattr(audit, "HOT_SHARE", 10)
    rows = [(i, "same text" if i % 3 else f"text {i % 7}", "en") for i in range(200)]
    docs, marks = run(spark, rows, [])
    got = {r.doc_id: r.failing & audit.COPY > 0 for r in audit.failures(docs, marks).collect()}
    assert got == {i: "E" in b for i, _, b in fails(rows)}


def test_equal_hash_of_other_text_is_no_copy(spark):
    docs, _ = run(spark, [(1, "one", "en"), (2, "two", "en"), (3, "one", "en")], [])
    keyed = audit.with_row_keys(docs.select("doc_id", "text")).withColumn("hash", F.lit(7).cast("long"))
    keyed = audit.stored(keyed)
    found = audit.copies(keyed, keyed.drop("text")).join(keyed, [audit.FILE, audit.ROW])
    assert [r.doc_id for r in found.collect()] == [3]


def test_empty(spark):
    docs, marks = run(spark, [], [])
    assert audit.audit(docs, marks).count() == 0

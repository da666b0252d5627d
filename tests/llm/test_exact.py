from collections import defaultdict

import pytest
from helpers import documents
from pyspark.sql import functions as F

from seriesmill.llm import exact
from seriesmill.llm.common import FILE, ROW

ROWS = [
    (1, "a b"), (2, "a b"), (3, "A b"), (4, None), (5, ""), (None, "a b"), (7, "x" * 100_000), (8, "x" * 100_000),
    (9, "x" * 99_999 + "y"), (2, "a b"), (2, "a b"), (11, "ß"), (12, "ß"), (-1, "only"),
]


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""])) for i, t, *_ in rows), key=repr), len(groups)


@pytest.mark.parametrize("weak", [False, True])
def test_groups(spark, weak):
    """With a digest of one bit nearly all texts collide, and the full bytes decide."""
    digest = (lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 1))) if weak else exact.sha256
    docs = documents(spark, ROWS, ("digest", "keep_id", "group_size", "file_path", "keeper"))
    got = exact.exact_groups(docs, digest=digest).collect()
    want, groups = expected(ROWS)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_state_over_batches(spark, tmp_path):
    """The state carries over micro-batches: one file each."""
    docs = documents(spark, ROWS * 3).repartition(5)
    got = exact.exact_groups(docs, bytes_per_batch=1).collect()
    want, groups = expected(ROWS * 3)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == groups


def test_keep_one(spark):
    docs = documents(spark, ROWS, ("kept",))
    stay = exact.keep_one(docs)
    assert stay.columns == docs.columns
    assert sorted(t or "" for (t,) in stay.select("text").collect()) == sorted({t or "" for _, t in ROWS})


def test_empty(spark):
    docs = documents(spark, [])
    assert exact.exact_groups(docs).count() == 0 and exact.keep_one(docs).count() == 0
    assert {FILE, ROW} <= set(exact.exact_groups(docs).columns)

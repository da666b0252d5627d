import math
import random
from collections import Counter, defaultdict

import pytest
from helpers import documents

from seriesmill.llm import quality


def kneser_ney(trusted):
    """Straight from the definition: log probability of the last character of a 5-gram."""
    counts = {5: Counter()}
    for text in trusted:
        marked = quality.normalised(text)
        counts[5].update(marked[i:i + 5] for i in range(len(marked) - 4))
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    rules = {}
    for n, c in counts.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.0
        raw = [i - (i + 1) * y * k[i + 1] / k[i] if k[i] else 0.5 * i for i in (1, 2, 3)]
        d = [min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), raw, strict=True)]
        total, taken = defaultdict(float), defaultdict(float)
        for g, x in c.items():
            total[g[:-1]] += x
            taken[g[:-1]] += d[min(x, 3) - 1]
        rules[n] = (d, total, taken)

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        n, c = len(gram), counts[len(gram)][gram]
        d, total, taken = rules[n]
        context = gram[:-1]
        if not total[context]:
            return p(gram[1:])
        return (c - d[min(c, 3) - 1] if c else 0) / total[context] + taken[context] / total[context] * p(gram[1:])

    return p


def perplexity(p, text):
    marked = quality.normalised(text or "")
    logs = [math.log(p(marked[i:i + 5])) for i in range(len(marked) - 4)]
    return math.exp(-sum(logs) / len(logs))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    good = lambda: " ".join("".join(draw.choices(["er", "th", "on", "ing"], k=draw.randint(1, 3))) for _ in range(draw.randint(1, 40)))
    found = [(i, good(), draw.choice(["en", "de", None]), "s") for i in range(120)]
    found += [(200 + i, "".join(draw.choices("#$%&*@!0123456789", k=80)), "en", "s") for i in range(10)]
    return found + [(300, None, "en", "s"), (301, "", "fr", "s"), (302, "日本\ttab  é", "fr", "s"), (None, "er th", "en", "s"), (0, found[0][1], "en", "s"),
                    (303, "er " * 40_000, "en", "s")]


@pytest.mark.parametrize("table_rows", [quality.TABLE_ROWS, 0])
def test_perplexities_and_thresholds(spark, rows, table_rows):
    """Both ways to look the table up, against the definition."""
    import zlib

    labels = [(i, 1) for i in range(100)] + [(200, 0), (None, 1), (5, None), (7, 1)]
    docs = documents(spark, rows, ("perplexity", "g5", "group", "n"))
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), table_rows=table_rows).collect()
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in range(100)}
    trusted = {i for i in range(100) if fold[i] != 0}
    p = kneser_ney([t or "" for i, t, *_ in rows if i in trusted and fold[i] != 1])
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(perplexity(p, t))
    assert len(got) == len(rows)
    for r in got:
        assert any(abs(r.perplexity - x) < 1e-4 * x for x in want[r.doc_id])
        assert r.kept == (r.perplexity <= r.threshold) and r.trusted == (r.doc_id in trusted)
    assert not any(r.kept for r in got if r.doc_id and 200 <= r.doc_id < 210)
    for lang in ("en", "de", None):
        own = [r.perplexity for r in got if r.lang == lang and r.trusted and fold[r.doc_id] == 1]
        assert {r.threshold for r in got if r.lang == lang} == {max(own)}


def test_empty_and_untaught(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(documents(spark, []), none).count() == 0
    got = quality.classify(documents(spark, [(1, "abc"), (2, None)]), none).collect()
    assert len(got) == 2 and all(r.kept for r in got)

import random
from fractions import Fraction

import numpy as np
import pytest
from helpers import documents

from seriesmill.llm import jaccard


def sets_of(text):
    words = (text or "").split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    """links, other texts and class (smallest id, of equal nodes too) per row."""
    sets = [frozenset(sets_of(t)) for _, t in rows]
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, others = [0] * n, [set() for _ in range(n)]
    for i in range(n):
        for j in range(n):
            same = sets[i] == sets[j]
            if i != j and (same or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) > 0):
                links[i] += 1
                if not same:
                    others[i].add(sets[j])
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    named = {}
    for i, (doc_id, _) in enumerate(rows):
        named.setdefault(find(i), []).append(doc_id)
    return [(rows[i][0], min((d for d in named[find(i)] if d is not None), default=None), links[i], len(others[i]), len(named[find(i)])) for i in range(n)]


def corpus(seed=3, families=12, members=14):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, name = [], 0
    for _ in range(families):
        base = draw.choices(words, k=draw.choice([6, 30, 80, 150]))
        for _ in range(draw.randint(1, members)):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4, 9])):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((name, " ".join(text)))
            name += 1
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "short"), (1004, "short"), (1005, "two words"), (None, rows[0][1]),
                   (7, rows[7][1]), (1006, "a b c d e " * 4000), (1007, "a b c d e " * 3990)]


@pytest.mark.parametrize("tile", [256, 3])
def test_against_brute_force(spark, monkeypatch, tile):
    """With three texts to a tile, clusters span many tile pairs and classes are joined after."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = corpus()
    got = jaccard.similar_texts(documents(spark, rows, ("node", "links", "class", "keeper"))).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.class_id, r.links, r.other_texts, r.class_size) for r in got), key=key) == sorted(brute(rows), key=key)
    assert sum(r.kept for r in got) == len({repr(x[1]) for x in brute(rows)})


def test_keep_one(spark):
    rows = corpus(5, 6, 6)
    docs = documents(spark, rows, ("kept",))
    stay = jaccard.keep_one(docs)
    assert stay.columns == docs.columns
    classes = {c for _, c, *_ in brute(rows)}
    found = [r.doc_id for r in stay.collect()]
    assert len(found) == len(classes) and set(found) - {None} <= classes


def test_empty(spark):
    docs = documents(spark, [])
    assert jaccard.similar_texts(docs).count() == 0 and jaccard.keep_one(docs).count() == 0


def test_prefix_is_shortened_until_the_recall():
    depth = jaccard.prefix_depth(0.8, 32, 12, 0.999)
    assert 1 - (1 - 0.8**depth) ** 32 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 32
    forest, draw, hits = jaccard.Forest(32, depth), np.random.default_rng(2), 0
    for _ in range(200):
        common = draw.integers(0, 1 << 63, 160).astype(np.uint64)
        a, b = (np.concatenate([common, draw.integers(0, 1 << 63, 20).astype(np.uint64)]) for _ in range(2))
        hits += bool((forest.prefixes(a) == forest.prefixes(b)).any())
    assert hits >= 198


def test_compare_is_exact():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 30, draw.integers(0, 25)).astype(np.uint64)) for _ in range(60)]
    got = jaccard.compare(sets, None, Fraction(4, 5))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            union = len(np.union1d(a, b))
            assert got[i, j] == (i != j and union > 0 and 5 * len(np.intersect1d(a, b)) >= 4 * union)

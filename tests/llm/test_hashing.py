import numpy as np
import pytest

from seriesmill.llm import hashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_every_code_within_the_radius():
    draw = np.random.default_rng(1)
    codes = draw.integers(0, 256, (3000, 8)).astype(np.uint8)
    codes[:500] = codes[0] ^ (draw.random((500, 8)) < 0.2).astype(np.uint8) * 5
    index = hashing.MultiIndex(codes)
    for code in [*codes[:5], *draw.integers(0, 256, (5, 8)).astype(np.uint8)]:
        for radius in (0, 3, 7, 8, 13, 21, 27, 64):
            assert list(index.within(code, radius)) == list(np.nonzero(hashing.distances(codes, code) <= radius)[0])


@pytest.mark.parametrize("size", [64, 96, 16])
def test_recall_order_and_scores(spark, monkeypatch, size):
    monkeypatch.setattr(hashing, "INDEX_BLOCK", 700)
    monkeypatch.setattr(hashing, "QUERY_BLOCK", 40)
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((10, size))
    x = (centres[draw.integers(0, 10, 2000)] + draw.standard_normal((2000, size))).astype(np.float32)
    x[100:160] = x[100]  # a hot vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(3000, None, 0), (3001, [0.0] * size, 0), (3002, [float("nan")] * size, 0), (3003, [None] + [1.0] * (size - 1), 0),
           (3020, [float("inf")] * size, 0), (3005, [1.0], 0), (None, x[0].tolist(), 0), rows[7]]
    frame = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS id", "2 AS vec", "'q' AS query")
    got = hashing.nearest(frame, "id % 20 = 0", 20).toPandas()
    x, hits, asked = x.astype(float), 0, range(0, 2000, 20)
    assert set(got["query_id"]) == set(asked)
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(2000), -score))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and q not in set(mine["vec_id"])
        assert np.allclose(mine["score"], score[mine["vec_id"]], atol=1e-9)
        assert list(mine["vec_id"]) == [i for _, i in sorted(zip(-mine["score"], mine["vec_id"], strict=True))]
        hits += len(set(best) & set(mine["vec_id"]))
    assert hits / (20 * len(asked)) >= 0.9


def test_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 0), (20, [1.0, 2.0], 0), (3, [0.5, -1.0], 0)], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hashing.nearest(few, "id % 20 = 0").collect())
    assert got == [(0, 1, 20, 5.0), (0, 2, 3, -1.5), (20, 1, 0, 5.0), (20, 2, 3, -1.5)]
    one = spark.createDataFrame([(0, [1.0], 0)], SCHEMA)
    assert hashing.nearest(one, "id % 20 = 0").count() == 0
    assert hashing.nearest(spark.createDataFrame([], SCHEMA), "id % 20 = 0").count() == 0


def neighbours(x, k=20, step=10):
    asked = np.arange(0, len(x), step)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    return asked, np.argsort(-score, axis=1)[:, :k]


@pytest.mark.parametrize("size", [64, 32])
def test_clustered_vectors_are_pruned(size):
    """Vectors in groups of like ones: few codes are looked at, fewer reranked, and recall is high."""
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((200, size))
    x = centres[draw.integers(0, 200, 8000)] + 0.15 * draw.standard_normal((8000, size))
    rotation = hashing.learn_rotation(x)
    radius, codes = hashing.learn_radius(x, rotation, 20), hashing.encode(x, rotation)
    index = hashing.MultiIndex(codes)
    asked, best = neighbours(x)
    found = [set(index.within(codes[i], radius)) for i in asked]
    recall = np.mean([len(set(b) & f) / 20 for b, f in zip(best, found, strict=True)])
    assert recall >= 0.9
    assert index.probed <= 0.2 * len(asked) * len(x)
    assert sum(map(len, found)) <= 0.1 * len(asked) * len(x)


def test_vectors_close_to_random_rerank_a_small_share():
    """No structure: substrings prune nothing, but the radius keeps most vectors from being reranked."""
    draw = np.random.default_rng(3)
    x = draw.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation = hashing.learn_rotation(x)
    radius, codes = hashing.learn_radius(x, rotation, 20), hashing.encode(x, rotation)
    index = hashing.MultiIndex(codes)
    asked, best = neighbours(x, step=60)
    found = [set(index.within(codes[i], radius)) for i in asked]
    assert np.mean([len(set(b) & f) / 20 for b, f in zip(best, found, strict=True)]) >= 0.9
    assert sum(map(len, found)) <= 0.15 * len(asked) * len(x)

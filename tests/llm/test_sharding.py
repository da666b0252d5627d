import random
import zlib

from helpers import documents

from seriesmill.llm import sharding


def test_heap_order():
    placed = sharding.least_loaded([(5, "a"), (5, "b"), (4, "c"), (3, "d"), (3, "e"), (3, "f")], 2)
    assert placed == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 1, "f": 0}


def test_groups_stay_together(spark):
    draw = random.Random(2)
    texts = ["w" * draw.randint(0, 400) + str(draw.randint(0, 300)) for _ in range(800)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "é" * 5000), (None, "no id"), (3, texts[3])]
    got = sharding.shard_by_size(documents(spark, rows, ("shard", "slot", "group", "bundle")), 6).collect()
    assert len(got) == len(rows)
    where, loads, slots = {}, [0] * 6, [[] for _ in range(6)]
    text_of = {}
    for i, t in rows:
        text_of.setdefault(i, t or "")
    for r in got:
        text = text_of[r.doc_id]
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        assert where.setdefault(text, r.shard) == r.shard
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(loads) - min(loads) < 1000


def test_one_group_of_a_third(spark):
    rows = [(i, "same text") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(600)]
    got = sharding.shard_by_size(documents(spark, rows), 4).collect()
    assert len({r.shard for r in got if r.doc_id < 300}) == 1
    assert {r.shard for r in got} == {0, 1, 2, 3}


def test_empty(spark):
    assert sharding.shard_by_size(documents(spark, []), 3).count() == 0


def plain_schedule(sizes, shards):
    """Largest first to the least-loaded shard, by looking at all shards every time."""
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[min(range(shards), key=lambda s: (loads[s], s))] += size
    return sorted(loads)


def test_loads_against_a_plain_scheduler(spark):
    """Groups that are all scheduled one by one give the loads of the plain schedule."""
    draw = random.Random(8)
    texts = ["x" * draw.randint(0, 3000) + str(k) for k in range(400)]
    rows = [(i, draw.choice(texts)) for i in range(900)]
    got = sharding.shard_by_size(documents(spark, rows), 5).collect()
    sizes, loads = {}, [0] * 5
    for _, t in rows:
        sizes[t] = sizes.get(t, 0) + len(t) + 8
    for r in got:
        loads[r.shard] += r.size
    assert min(sizes.values()) * 5 * sharding.FINE > sum(sizes.values())  # none is bundled
    assert sorted(loads) == plain_schedule(sizes.values(), 5)

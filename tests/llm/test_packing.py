import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import documents
from tokenizers import Tokenizer

from seriesmill.llm import packing
from seriesmill.llm.bytelevel import ByteLevel

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(library):
    fast, draw = ByteLevel(PATH), random.Random(4)
    letters = "abcdeé ñÿŁǅ'stre  \n\t\r\x85\xa0\x1c0½²9.,<|>_日🎉‍"
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(3000)]
    for text in [*texts, "", "x <|endoftext|> y", "a" * 5000, " " * 300 + "b"]:
        assert list(fast.ids(text)) == library.encode(text, add_special_tokens=False).ids


def serial(totals, quanta, window):
    """Deficit round-robin one queue after the other: queue of every served token."""
    served, left, deficit = [], list(totals), [0] * len(totals)
    while any(left):
        for q, quantum in enumerate(quanta):
            deficit[q] += quantum
            take = min(left[q], deficit[q] // packing.UNIT)
            deficit[q] -= take * packing.UNIT
            left[q] -= take
            served += [q] * take
    return served


def test_rounds_are_those_of_the_serial_scheduler():
    totals, window = [5000, 700, 3, 0, 1800], 64
    quanta = [max(1, -(-window * packing.UNIT * n // sum(totals))) for n in totals]
    order, rounds = serial(totals, quanta, window), packing.Rounds(totals, quanta, window)
    got = np.full(sum(totals), -1)
    for q, total in enumerate(totals):
        at, lengths = 0, []
        while at < total:
            lengths.append(min(37, total - at))
            at += lengths[-1]
        lengths = np.array(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        row, start, size, place = rounds.pieces(np.full(len(lengths), q), starts, lengths)
        assert (place // window == (place + size - 1) // window).all() and (size > 0).all()
        token = starts[row] + start
        nth = {t: i for i, t in enumerate(j for j, s in enumerate(order) if s == q)}
        for t, s, p in zip(token, size, place, strict=True):
            assert (got[p:p + s] == -1).all()
            got[p:p + s] = q
            assert [nth[x] for x in range(p, p + s)] == list(range(t, t + s))
    assert list(got) == order


@pytest.mark.parametrize("targets", [None, {"s0": 0.7, "s1": 0.2}])
def test_every_token_once_and_mixed(spark, library, targets):
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choices(["the", "quick", "brown", "é", "fox\n"], k=draw.randint(0, 300))), "en",
             draw.choice(["s0", "s0", "s0", "s1", "s2", None])) for i in range(200)]
    rows += [(500, None, "en", "s0"), (501, "", "en", "s1"), (502, "long " * 20_000, "en", "s0"), (None, "no id", "en", "s0")]
    docs = documents(spark, rows, ("queue", "part", "within", "ids", "at")).repartition(4)
    got = packing.pack(docs, PATH, window=256, targets=targets).toPandas()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    for doc_id, pieces in got.groupby("doc_id", dropna=False):
        pieces, mine = pieces.sort_values("start"), ids[None if doc_id != doc_id else int(doc_id)]
        assert b"".join(map(bytes, pieces["ids"])) == mine.tobytes()
        assert list(pieces["start"]) == list(np.cumsum(pieces["length"]) - pieces["length"])
        assert (pieces["doc_tokens"] == len(mine)).all() and zlib.crc32(mine.tobytes())
    total, last = sum(map(len, ids.values())), got["sequence_id"].max()
    assert last == (total - 1) // 256 and got["length"].sum() == total
    for name, pieces in got.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert list(pieces["offset"]) == list(np.cumsum(pieces["length"]) - pieces["length"])
        assert pieces["length"].sum() == (256 if name < last else total - 256 * last)
    source = {i: s for i, _, _, s in rows}
    first = got[got["sequence_id"] < 3]
    share = first["length"][[source.get(None if i != i else int(i)) == "s0" for i in first["doc_id"]]].sum() / first["length"].sum()
    own = sum(len(v) for k, v in ids.items() if source[k] == "s0") / total
    if targets is None:
        assert abs(share - own) < 0.03
    else:
        assert abs(share - 0.7 / (0.9 + sum(len(v) for k, v in ids.items() if source[k] in ("s2", None)) / total)) < 0.03


@pytest.mark.parametrize("targets", [None, {"s299": 0.5, "s3": 0.1, None: 0.05}])
def test_every_source_has_a_queue(spark, library, targets):
    draw, window = random.Random(8), 64
    rows = [(i, " ".join(draw.choices(["the", "quick", "é", "fox\n"], k=draw.randint(1, 25))), "en",
             f"s{i % 300}" if i % 301 else None) for i in range(900)]
    got = packing.pack(documents(spark, rows).repartition(3), PATH, window=window, targets=targets).toPandas()
    size = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    count, total = {}, {}
    for i, s in source.items():
        count[s], total[s] = count.get(s, 0) + 1, total.get(s, 0) + size[i]
    queues = sorted(total, key=lambda s: (-count[s], s is not None, s or ""))
    totals, whole = [total[s] for s in queues], sum(total.values())
    if targets:
        share = [targets.get(s, total[s] / whole) for s in queues]
        quanta = [max(1, round(window * packing.UNIT * x / sum(share))) for x in share]
    else:
        quanta = [max(1, -(-window * packing.UNIT * n // whole)) for n in totals]
    order = [queues[q] for q in serial(totals, quanta, window)]
    served, taken = [None] * whole, {i: set() for i in size}
    for r in got.itertuples():
        for k in range(r.length):
            place = r.sequence_id * window + r.offset + k
            assert served[place] is None
            served[place] = (source[r.doc_id],)
            taken[r.doc_id].add(r.start + k)
    assert [s for s, in served] == order
    assert taken == {i: set(range(n)) for i, n in size.items()}
    for i, pieces in got.groupby("doc_id"):
        want = np.array([*library.encode(rows[i][1], add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces = pieces.sort_values("start")
        assert b"".join(map(bytes, pieces["ids"])) == want
        places = pieces["sequence_id"] * window + pieces["offset"]
        assert places.is_monotonic_increasing


def test_repeated_rows_and_empty(spark):
    rows = [(1, "same words here")] * 5
    got = packing.pack(documents(spark, rows), PATH).toPandas()
    assert len(got) == 5 and sorted(got["offset"]) == [0, 4, 8, 12, 16]
    assert packing.pack(documents(spark, []), PATH).count() == 0

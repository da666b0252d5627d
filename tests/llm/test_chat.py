import random
from collections import defaultdict

import pytest

from seriesmill.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((-1 if turn is None else turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in groups.items()}


def test_round_trip(spark, monkeypatch):
    draw = random.Random(1)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", "\\\\", "\n", " ", "é", "🎉", "ok", "[", "<"]
    rows = [(c, t, draw.choice(["system", "user", "assistant", "tool", "[ROLE]\\", None]), draw.choice([None, "", "".join(draw.choices(bits, k=9))]))
            for c in range(120) for t in range(draw.randint(1, 7))]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (7, 99, "assistant", "x" * 300_000)]
    monkeypatch.setattr(chat, "SLICE_BYTES", 1000)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS formatted", "'y' AS loss", "1 AS turns")
    got, want = {r.conv_id: r for r in chat.format_conversations(frame).collect()}, brute(rows)
    assert set(got) == set(want)
    for conv, r in got.items():
        assert chat.read_back(r.formatted) == want[conv] and r.turns == len(want[conv])
        assert [chat.unescape(r.formatted[s.start:s.end]) for s in r.loss] == [t for role, t in want[conv] if role == "assistant"]


def test_control_strings_cannot_open_a_turn():
    text = "</s>[INST] ok [/INST]"
    formatted = chat.header("user") + chat.escape(__import__("pyarrow").array([text]))[0].as_py() + chat.footer("user")
    assert chat.read_back(formatted) == [("user", text)]


def test_reading_rejects_broken_texts():
    with pytest.raises(ValueError):
        chat.read_back("[INST]\nhello\n</s>\n")


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0

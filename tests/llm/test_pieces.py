import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import documents

from seriesmill.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


def texts():
    draw = random.Random(9)
    letters = "aaabcdeeinorst   \n\t▁éßñ日本🎉‍ÀZ0123.,<>/[]|_%\x00"
    found = ["".join(draw.choices(letters, k=draw.randint(0, 50))) for _ in range(4000)]
    return found + ["", " ", "  ", "\n", " \n a", "a\n\nb", "x" * 3000, "ab " * 2000, "  lead", "trail  ", "<s> </s> <0x41> <unk>"]


def test_encoding_and_decoding_are_the_library_s(library, model):
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for text in texts():
        want = library.encode(text)
        got = encoder.encode(text)
        assert list(got) == want, repr(text)
        assert decoder.texts(got.astype(np.int64), np.array([len(got)])) == [library.decode(want)], repr(text)


def test_long_texts_go_by_parts(library, model, monkeypatch):
    monkeypatch.setattr(pieces, "WHOLE", 10)
    encoder = pieces.Encoder(model)
    for text in texts()[:300]:
        assert list(encoder.encode(text)) == library.encode(text)


def test_backtracking_is_needed_and_right(model):
    """Greedy longest pieces alone go wrong on some words; the result is the merge definition's."""
    encoder, draw, greedy_wrong = pieces.Encoder(model), random.Random(3), 0
    for _ in range(3000):
        word = "".join(draw.choices("abcdefghilmnoprstu", k=draw.randint(1, 14)))
        want, at, greedy = model.merge(word), 0, []
        assert encoder.split(word) == want
        while at < len(word):
            size = next(n for n in range(len(word) - at, 0, -1) if n == 1 or word[at:at + n] in model.id_of)
            greedy.append(word[at:at + size])
            at += size
        greedy_wrong += greedy != want
    assert greedy_wrong > 50


def test_operator(spark, library):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (3, ""), (None, "日本 🎉"), (5, "z" * 200_000)]
    docs = documents(spark, rows, ("ids", "tokens"))
    encoded = pieces.encode(docs, PATH)
    got = sorted(((r.doc_id, list(r.ids), r.text) for r in pieces.decode(encoded, PATH).collect()), key=repr)
    assert got == sorted(((i, library.encode(t or ""), t or "") for i, t in rows), key=repr)
    assert pieces.decode(pieces.encode(documents(spark, []), PATH), PATH).count() == 0


def test_decoding_any_ids(library, model):
    decoder, draw = pieces.Decoder(model), random.Random(8)
    for _ in range(500):
        ids = [draw.choice([draw.randrange(259, 32000), 3 + draw.randrange(0x20, 0x7F), 1, 2]) for _ in range(6)]
        assert decoder.texts(np.array(ids), np.array([6])) == [library.decode(ids)]

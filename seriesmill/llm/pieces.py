"""Exact merge-type encoding by backtracking, and decoding, for SentencePiece BPE vocabularies.

The vocabulary file is read here; the library itself is not used.  A piece sequence is the
encoding of a text exactly if every two neighbours are compatible, that is, if merging their
joined text anew gives the same two pieces.  So the text is walked with the longest piece at each
position (from one Aho-Corasick pass), shorter ones when the neighbour does not fit, and one step
back when none fits; a bitfield keeps positions from which no step succeeded.

A piece never joins two words, so each distinct word is encoded once per task and remembered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from seriesmill.llm.memo import Memo, slices, spans

SPACE = "▁"
# Kinds of pieces in the file, and what decoding gives for the unknown piece.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_TEXT = " ⁇ "
SLICE_BYTES = 2 << 20
# Longer texts are split into words bit by bit.
WHOLE = 8 << 20
# Words that a worker process remembers, over all its tasks.
WORDS = 700_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield number, raw[at:at + size]
            at += size


class PieceModel:
    """Pieces, scores and kinds of a model file with byte fallback and without normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        self.pieces: list[str] = []
        kinds, scores = [], []
        for number, body in message:
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(body))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0])
                kinds.append(piece[3])
        rules = {3: 1, 4: 1, 5: 1} | dict(_fields(next(body for number, body in message if number == 3)))
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or rules.get(2) or not rules[3] or rules[4] or not rules[5]:
            raise ValueError("only plain BPE models with a leading space and without normalisation are supported")
        self.kinds = kinds
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        self.score = {p: scores[i] for p, i in self.id_of.items()}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        # A word ends where a space follows something else, unless a piece spans such a place.
        joins = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)
        self.words = re.compile("(?s).+" if joins else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.joins = joins

    def merge(self, text: str) -> list[str]:
        """The definition: join the best-scored neighbours, leftmost first, until none joins."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def piece_ids(self, piece: str) -> list[int]:
        found = self.id_of.get(piece)
        if found is not None:
            return [found]
        return [self.byte_id[b] for b in piece.encode()] if self.byte_id else [self.unknown]


class Encoder:
    def __init__(self, model: PieceModel):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        # Pieces that merging their own text does not give can never appear.
        usable = {p for p in model.id_of if len(p) > 1 and model.merge(p) == [p]}
        for piece in usable:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        # Length of the next shorter piece that begins a piece; a single character always may.
        self.shorter = {p: next(n for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in usable) for p in usable}
        self.boundary = Boundaries(model)
        self.memo = Memo(self.encode_element, WORDS)
        self.lines_apart = not model.joins and not any("\n" in p for p in model.id_of)

    def split(self, word: str) -> list[str]:
        """Pieces of a word (single characters outside the vocabulary included)."""
        size = len(word)
        longest = [1] * size
        for last, length in self.automaton.iter(word):  # longer matches of a start come later
            longest[last + 1 - length] = length
        boundary, shorter = self.boundary, self.shorter
        failed, any_failed = bytearray(size // 8 + 1), False
        starts: list[int] = []
        at, before, length = 0, -1, longest[0]
        while at < size:
            end = at + length
            if (before < 0 or boundary[word[before:end]] == at - before) and not (
                any_failed and failed[end >> 3] >> (end & 7) & 1
            ):
                starts.append(at)
                before, at = at, end
                if at < size:
                    length = longest[at]
                continue
            while length == 1:  # nothing fits here: back to a shorter piece before
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                length = at - starts[-1]
                at = starts.pop()
                before = starts[-1] if starts else -1
            length = shorter[word[at:at + length]]
        starts.append(size)
        return [word[a:b] for a, b in pairwise(starts)]

    def encode_word(self, word: str) -> list[int]:
        ids: list[int] = []
        known = self.model.id_of
        for piece in self.split(word):
            found = known.get(piece)
            if found is None:
                ids.extend(self.model.piece_ids(piece))
            else:
                ids.append(found)
        return ids

    def encode_element(self, element: str) -> list[int]:
        """What stands between two single spaces: a word, or a line break and the word after it."""
        if element[:1] == "\n":
            return self.model.piece_ids("\n") + (self.encode_word(element[1:]) if len(element) > 1 else [])
        if "\n" in element or element[:1] == SPACE:
            return [i for word in self.model.words.findall(element) for i in self.encode_word(word)]
        return self.encode_word(SPACE + element)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.lines_apart and len(text) <= WHOLE and "  " not in text and text[0] != " " and SPACE not in text:
            return self.memo.ids(text.replace("\n", " \n").split(" "))
        words = self.model.words.finditer(SPACE + text.replace(" ", SPACE))
        found = []
        while some := [word.group() for word in islice(words, 100_000)]:
            found.append(self.memo.ids(some))
        return np.concatenate(found)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process: what it remembers serves the next task too."""
    return Encoder(PieceModel(path))


class Boundaries(dict):
    """Text -> where merging it anew leaves its only boundary, 0 if it gives one piece or several."""

    ENTRIES = 1_000_000

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, text: str) -> int:
        if len(self) > self.ENTRIES:
            self.clear()
        parts = self.model.merge(text)
        self[text] = at = len(parts[0]) if len(parts) == 2 else 0
        return at


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


class Decoder:
    """Bytes of all ids in one flat table; a text is one gather."""

    def __init__(self, model: PieceModel):
        import codecs

        codecs.register_error("one-by-one", _one_by_one)
        texts = []
        for piece, kind in zip(model.pieces, model.kinds, strict=True):
            if kind == BYTE:
                texts.append(bytes([int(piece[3:5], 16)]))
            else:
                texts.append({CONTROL: "", UNKNOWN: UNKNOWN_TEXT}.get(kind, piece.replace(SPACE, " ")).encode())
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.control = np.array([k == CONTROL for k in model.kinds])
        self.leading = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(model.pieces, model.kinds, strict=True)])

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive id lists of the given lengths."""
        lengths = self.lengths[ids]
        raw = self.flat[spans(self.starts[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(counts)
        found = []
        for first, stop in zip(last - counts, last, strict=True):
            # The space that encoding put in front goes, also after control pieces.
            while first < stop and self.control[ids[first]]:
                first += 1
            skip = 1 if stop > first and self.leading[ids[first]] else 0
            found.append(raw[ends[first] + skip:ends[stop]].decode("utf-8", "one-by-one"))
        return found


def encode(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (array<int>) of every row, without begin or end ids.

    A null or empty text has no ids.  Repeated rows are encoded one by one, other columns are
    ignored, an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path)
        for batch in batches:
            texts = batch.column("text")
            for start, end in slices(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
                found = [encoder.encode(t) for t in texts.slice(start, end - start).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, end - start),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))),
                ], names=["doc_id", "ids"])

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds the decoded text to (doc_id, ids).  Null ids count as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(PieceModel(model_path))
        for batch in batches:
            counts = pa.compute.fill_null(pa.compute.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            for start, end in slices(counts * 4, SLICE_BYTES):
                rows = batch.slice(start, end - start)
                ids = rows.column("ids").flatten().to_numpy(zero_copy_only=False)
                texts = decoder.texts(ids, counts[start:end].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")

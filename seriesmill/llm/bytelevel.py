"""Token ids of a byte-level vocabulary file of the `tokenizers` library.

The ids of such a vocabulary are its merge ranks, so the faster `tiktoken` gives the same ids from
the same file.  Texts with characters beyond Latin Extended-B (where the Unicode tables of the two
libraries may differ in age), or with the vocabulary's special strings, go to `tokenizers` itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# The split pattern of the vocabulary, the last character of the common range.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LAST = "ɏ"


def byte_of_character() -> dict[str, int]:
    """Visible characters stand for themselves in the file; the other bytes follow from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([f"[^\\x00-{LAST}]", *map(re.escape, special)]))
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte = byte_of_character()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.other.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        return np.array(self.fast.encode_ordinary(text), dtype=np.int64)

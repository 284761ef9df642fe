"""Sizes of texts in tokens of a public tokenizer, given by the path of its vocabulary file."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Default vocabulary; a parameter of every operator that needs one.
MULTILINGUAL = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how the byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteTokens:
    """A byte-level vocabulary of ranks (.tiktoken). Tokens are bytes of the text, so their places are known."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def count(self, texts: list[str]) -> list[int]:
        return [len(self.encoding.encode_ordinary(t)) for t in texts]

    def tokens_before(self, text: str) -> np.ndarray:
        """For each place between characters (0 to their number): how many tokens end at or before it."""
        ends = np.cumsum(self.sizes[self.encoding.encode_ordinary(text)])
        raw = np.frombuffer(text.encode(), np.uint8)
        places = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        return np.searchsorted(ends, places, "right")


class PieceTokens:
    """A sentencepiece model (.model)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class JsonTokens:
    """A tokenizers file (.json)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True

    def count(self, texts: list[str]) -> list[int]:
        return [len(self.model.encode(t, add_special_tokens=False)) for t in texts]


@lru_cache(4)
def load(path: str) -> ByteTokens | PieceTokens | JsonTokens:
    """The tokenizer of a file, read once by each worker. Lone surrogates can't occur in Spark strings."""
    kind = {"tiktoken": ByteTokens, "model": PieceTokens, "json": JsonTokens}.get(path.rsplit(".", 1)[-1])
    if kind is None:
        raise ValueError(f"no tokenizer for {path}")
    return kind(path)

"""Texts -> token ids of a public byte-level BPE vocabulary.

Byte pairs that occur in no token of the vocabulary mark certain cuts: no merge can span them. Each pre-token is cut there, the fragments
are encoded independently, and the ids joined. Fragments repeat far more often than words, so a bounded memory of fragments pays.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fragments and pre-tokens that a worker remembers; then it starts afresh.
REMEMBERED = 200_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.tiktoken as installed with the public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteBpe:
    """Encoder of one vocabulary: a file with a base64 token and its rank on each line."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with Path(path).open("rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self._split = regex.compile(pattern).findall
        self.together = {t[i : i + 2] for t in self.ranks for i in range(len(t) - 1)}
        self._known: dict[str, list[int]] = {}
        self._fragments: dict[bytes, list[int]] = {}

    def cuts(self, piece: bytes) -> list[bytes]:
        """``piece`` cut between all bytes that no token holds side by side."""
        at = [0, *(i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in self.together), len(piece)]
        return [piece[a:b] for a, b in zip(at, at[1:])]

    def _piece(self, word: str) -> list[int]:
        piece = word.encode()
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids: list[int] = []
        for f in self.cuts(piece):
            got = self._fragments.get(f)
            if got is None:
                got = self._bpe._encode_single_piece(f)
                if len(self._fragments) >= REMEMBERED:
                    self._fragments.clear()
                if len(f) <= 64:
                    self._fragments[f] = got
            ids += got
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; special tokens in it are ordinary text. Null and empty texts have no ids: an empty list."""
        ids: list[int] = []
        for word in self._split(text or ""):
            got = self._known.get(word)
            if got is None:
                got = self._piece(word)
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                if len(word) <= 64:
                    self._known[word] = got
            ids += got
        return ids


def encoded(df: DataFrame, text: str, out: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with the list of ids of ``text`` in column ``out``.

    ``vocabulary`` is the path of the file, the same on all executors; the installed one if not given. No shuffle: each task encodes the
    rows it reads, whole texts whatever their length.
    """
    path = vocabulary or default_vocabulary()
    pat = pattern or default_pattern()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = ByteBpe(path, pat)
        for texts in batches:
            yield pd.Series([bpe.encode(t) for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<int>")(text))

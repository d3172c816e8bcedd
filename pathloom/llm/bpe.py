"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

A piece is a sequence of bytes; as Latin-1 it is a string in which pyahocorasick finds the longest token from a byte on.
Encoding walks left to right, takes the longest token that may stand beside the one before it, falls back to that
token's next shorter prefix, and steps back when none fits. Two adjacent tokens may stand side by side if merging their joined bytes by rank would leave exactly
them; this is decided by undoing merges around the seam, and remembered. A sequence whose neighbours are all compatible
is the one that merging by rank yields, and each position is given up at most once, so the work is linear.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch, map_rows, texts

#: Entries of the memo of pieces and of the memo of pairs, in each Python worker; a full memo starts anew.
MEMO = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairs:
    """Exact BPE over bytes for a vocabulary in which each token's rank is its id and its merge's priority."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.shorter: dict[int, int] = {}  # a token's longest proper prefix that is a token
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}  # the pair that a token is merged from
        self.fits: dict[int, bool] = {}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.search = ahocorasick.Automaton()
        for i, t in self.tokens.items():
            if (prefix := next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), None)) is not None:
                self.shorter[i] = prefix
            self.search.add_word(t.decode("latin-1"), i)
        self.search.make_automaton()
        for i, t in sorted(self.tokens.items()):
            prefix = self.shorter.get(i)
            while prefix is not None:
                rest = ranks.get(t[len(self.tokens[prefix]) :])
                if rest is not None and prefix < i and rest < i and self._compatible(prefix, rest):
                    self.merged[prefix, rest], self.parts[i] = i, (prefix, rest)
                    break
                prefix = self.shorter.get(prefix)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves left and right apart: undo the later of the two merges at the seam, over and
        over, and look for a merge across it that would have come first."""
        before = 1 << 62  # merges across the seam matter only if they precede this one
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # ties: of two equal tokens, the left one is merged first, so the right one is undone first
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def compatible(self, left: int, right: int) -> bool:
        pair = left << 20 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[pair] = self._compatible(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None or not piece:
            return [whole] if piece else []
        text, length, search, compatible = piece.decode("latin-1"), self.length, self.search, self.compatible
        n, at, out, last = len(piece), 0, [], None
        longest: dict[int, int] = {}
        open_ends = bytearray(b"\1") * (n + 1)
        ahead = search.iter_long(text)
        token = next(ahead)[1]
        while True:
            end = at + length[token]
            if open_ends[end] and (last is None or compatible(last, token)):
                out.append(token)
                if end == n:
                    return out
                at, last = end, token
                if (token := longest.get(at)) is None:
                    if ahead is None:  # off the chain of longest matches
                        ahead = search.iter_long(text, at)
                    token = longest[at] = next(ahead)[1]
                else:
                    ahead = None
            elif (token := self.shorter.get(token)) is not None:
                ahead = None
            elif last is None:
                raise ValueError("the vocabulary can't spell this piece")
            else:  # no token that starts here fits: nothing may end here, and the token before is tried shorter
                open_ends[at] = 0
                token = out.pop()
                at -= length[token]
                last, ahead = out[-1] if out else None, None


class _Pieces(dict):
    """piece -> its ids as little-endian 32-bit integers"""

    def __init__(self, bpe: BytePairs):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Texts to ids and back, by a vocabulary file and the pattern that cuts a text into pieces."""

    def __init__(self, path: str, pattern: str):
        self.bpe = BytePairs(read_ranks(path))
        self.cut = regex.compile(pattern)
        self.pieces = _Pieces(self.bpe)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bpe.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row. Null and empty texts have no ids; rows that repeat are each encoded;
    null doc_ids and other columns don't matter. Nothing is shuffled."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        ids = [np.frombuffer(c.encode(t), "<u4").astype("int32") for t in b.column(1).to_pylist()]
        return batch(doc_id=b.column(0), ids=pa.array(ids, pa.list_(pa.int32())))

    return map_rows(texts(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the inverse of encode. Ids that spell no valid UTF-8 have replacement characters; null is empty."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        found = [c.decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace") for x in b.column(1).to_pylist()]
        return batch(doc_id=b.column(0), text=pa.array(found, pa.string()))

    return map_rows(encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids, and returns digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.
    Edge cases as in encode(); an empty text has 0 tokens and the digest of no bytes, twice."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple[int, str, str]]:
        c = codec(path, pattern)
        for t in b.column(1).to_pylist():
            ids = c.encode(t)
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, back = zip(*rows(b), strict=True)
        return batch(doc_id=b.column(0), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids), decoded_sha256=pa.array(back))

    return map_rows(texts(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Packing of tokenised documents into sequences: first-fit decreasing by a tournament tree, in random groups.

Documents go to groups by a hash of their id and text, so a group is a random part of the corpus, with a bounded number
of tokens; groups are packed independently, each in one task. In a group every document gives its full sequences first.
The remainders, longest first, each go to the first sequence that has room; a tournament tree over the sequences' free
space finds it in logarithmic time. Then sequences that still have a gap of more than MIN_GAP tokens are filled by
cutting what lies in the emptiest ones, and the one that is left at last is cut at powers of two.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, release, texts

if TYPE_CHECKING:
    from tokenizers import Tokenizer

SIZE, END, MIN_GAP = 4096, 2, 32
#: Bytes of text in a group, about.
GROUP_BYTES = 12_000_000
#: Pieces that a task remembers, about, those of up to so many characters, and characters of text that it takes at once: the
#: tokenizer needs some 200 bytes of memory for each; new pieces that it is given at once, and rows of a batch that are.
MEMO, REMEMBERED, AT_ONCE = 200_000, 64, 1 << 18
LEARNED, ROWS = 2000, 200
#: White space to Python, but not to the tokenizer; white space to both.
SEPARATORS, WHITE = re.compile("[\x1c-\x1f]"), re.compile("[^\\S\x1c-\x1f]")
#: A character that isn't white space, a visible ASCII character or a letter of Latin-1; the pieces of a text of others, in lower
#: case; and the tokenizer's normalizer and pre-tokenizer that take a text apart like this.
OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\sa-zß-öø-ÿ0-9]+")
TAKEN_APART = json.dumps(
    [
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ]
)


class FirstFit:
    """A tournament tree: each leaf is a bin's free space, each inner node the larger of its two."""

    def __init__(self, bins: int, space: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [space] * (2 * self.leaves)

    def put(self, n: int) -> int:
        """The first bin that has room for n; takes it there."""
        free, k = self.free, 1
        if free[1] < n:
            raise ValueError("no bin has room")
        while k < self.leaves:
            k *= 2
            k += free[k] < n
        at = k - self.leaves
        free[k] -= n
        while k > 1:
            k //= 2
            free[k] = max(free[2 * k], free[2 * k + 1])
        return at


def pack(lengths: list[int], size: int = SIZE, min_gap: int = MIN_GAP) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length), for documents of so many tokens."""
    full = [[(d, s, size)] for d, n in enumerate(lengths) for s in range(0, n - size + 1, size)]
    rest = sorted(((n % size, d) for d, n in enumerate(lengths) if n % size), key=lambda x: (-x[0], x[1]))
    tree, bins = FirstFit(len(rest), size), []
    for n, d in rest:
        at = tree.put(n)
        if at == len(bins):
            bins.append([])
        bins[at].append((d, lengths[d] - n, n))
    fill = lambda b: sum(x[2] for x in b)
    whole = [b for b in bins if size - fill(b) <= min_gap]
    open_ = sorted((b for b in bins if size - fill(b) > min_gap), key=fill)
    while len(open_) > 1:
        into, gap = open_.pop(), 0
        gap = size - fill(into)
        while gap and open_:
            d, s, n = open_[0].pop()
            take = min(n, gap)
            into.append((d, s + n - take, take))
            gap -= take
            if take < n:
                open_[0].append((d, s, n - take))
            elif not open_[0]:
                open_.pop(0)
        (whole if not gap else open_).append(into)
    for b in open_:
        left = fill(b)
        while left:
            part, want = [], 1 << (left.bit_length() - 1)
            left -= want
            while want:
                d, s, n = b.pop(0)
                take = min(n, want)
                part.append((d, s, take))
                want -= take
                if take < n:
                    b.insert(0, (d, s + take, n - take))
            whole.append(part)
    return full + whole


class _Known(dict):
    """Numbers of pieces: those that are remembered, and those that are new in the texts at hand."""

    def __missing__(self, piece: str) -> int:
        self[piece] = len(self)
        return len(self) - 1


@lru_cache(maxsize=1)
def loaded(path: str) -> tuple[Tokenizer, Tokenizer]:
    """The tokenizer of a file; and one that takes pieces between spaces, in lower case, as they are. Both have one model, so
    its vocabulary is held once. For one task: workers that wait for others would hold it too."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    light = Tokenizer(whole.model)
    light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    release()
    return whole, light


@lru_cache(maxsize=1)
def described(path: str) -> tuple[np.ndarray | None, tuple[str, ...]]:
    """Which ids end a piece, or None if the tokenizer doesn't take texts apart as PIECE does; and its special tokens. Reading
    the whole file takes some 30 MB that Python doesn't give back, so the driver does it, for all tasks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, model = tuple(x["content"] for x in spec["added_tokens"]), spec["model"]
    size = 1 + max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
    if size > 1 << 16:
        raise ValueError("ids must fit 16 bits")
    if any(x.split() != [x] for x in special):
        raise ValueError("a special token has white space in it")
    if json.dumps([spec["normalizer"], spec["pre_tokenizer"]]) != TAKEN_APART or not (end := model.get("end_of_word_suffix")):
        return None, special
    ends = np.zeros(size, bool)
    ends[[k for x, k in model["vocab"].items() if x.endswith(end)]] = True
    return ends, special


class Encoder:
    """Texts' ids, as little-endian 16-bit integers (the vocabulary has under 65,536 entries).

    The tokenizer puts a text in lower case and takes it apart into pieces, none of which has white space in it; its ids are
    those of the pieces. Texts are taken in parts of about AT_ONCE characters, cut at white space. In a part of plain
    characters, the pieces are told by PIECE; in others, by words: one with other characters, or with a special token's
    string, is given to the tokenizer as it is. Pieces have numbers. New ones of a part are given to the tokenizer together;
    the last token of a piece is told by its id. Those that are met most are kept in a memo."""

    def __init__(self, path: str, told: tuple[np.ndarray | None, tuple[str, ...]] | None = None):
        """told: described(path)."""
        self.path, (self.ends, self.special) = path, told or described(path)
        self.forget()

    def forget(self, most: int = 0) -> None:
        """Keeps the `most` pieces that were met most often."""
        if not most:
            self.words, self.ids, self.start, self.met = _Known(), np.zeros(0, "<u2"), np.zeros(1, np.int64), np.zeros(0, np.int64)
            return
        some = np.sort(np.argsort(-self.met, kind="stable")[:most])
        names = list(self.words)
        self.words = _Known((names[k], i) for i, k in enumerate(some.tolist()))
        self.ids, self.start = self.of(some)
        self.met = self.met[some] // 2

    def of(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces, one behind another, and where each begins."""
        length = (self.start[1:] - self.start[:-1])[pieces]
        to = np.append(0, np.cumsum(length))
        return self.ids[np.arange(to[-1]) + np.repeat(self.start[pieces] - to[:-1], length)], to

    def plainly(self, text: str) -> bytes:
        return np.array(loaded(self.path)[0].encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one behind another, and how many each has. One that begins with a line's end is a word."""
        if any(p[0] == "\n" for p in pieces):
            plain = [p for p in pieces if p[0] != "\n"]
            ids, n = self.learn(plain) if plain else (np.zeros(0, "<u2"), np.zeros(0, np.int64))
            found = iter(np.split(ids, np.cumsum(n)[:-1]) if plain else ())
            own = [np.frombuffer(self.plainly(p[1:]), "<u2") if p[0] == "\n" else next(found) for p in pieces]
            return np.concatenate(own), np.array([*map(len, own)], np.int64)
        if len(pieces) > LEARNED:
            ids, n = zip(*(self.learn(pieces[k : k + LEARNED]) for k in range(0, len(pieces), LEARNED)), strict=True)
            return np.concatenate(ids), np.concatenate(n)
        ids = np.array(loaded(self.path)[1].encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u2")
        to = np.flatnonzero(self.ends[ids]) + 1
        if len(to) == len(pieces) and to[-1] == len(ids):
            return ids, np.diff(to, prepend=0)
        own = [self.plainly(p) for p in pieces]  # an id ends something else
        return np.frombuffer(b"".join(own), "<u2"), np.array([len(x) // 2 for x in own], np.int64)

    def pieces(self, text: str) -> list[str]:
        if self.ends is not None and not OTHER.search(text) and not any(x in text for x in self.special):
            return PIECE.findall(text.lower())
        out = []
        for word in WHITE.split(text) if SEPARATORS.search(text) else text.split():
            if self.ends is None or OTHER.search(word) or any(x in word for x in self.special):
                out += ["\n" + word] * bool(word)
            else:
                out += PIECE.findall(word.lower())
        return out

    def known(self, parts: list[str]) -> list[bytes]:
        """The ids of each of these texts, which are taken at once."""
        cut = [self.pieces(t) for t in parts]
        before = len(self.words)
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        new = list(islice(self.words, before, None))
        if new:
            ids, n = self.learn(new)
            self.ids, self.start = np.append(self.ids, ids), np.append(self.start, self.start[-1] + np.cumsum(n))
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
        self.met += np.bincount(numbers, minlength=len(self.met))
        ids, to = self.of(numbers)
        to = to[np.cumsum([0, *map(len, cut)])].tolist()
        if long := [k for k, p in enumerate(new, before) if len(p) > REMEMBERED]:
            self.met[long] = -1
            self.forget(len(self.words) - len(long))
        elif len(self.words) > MEMO:
            self.forget(MEMO // 2)
        return [ids[i:j].tobytes() for i, j in zip(to, to[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        owner: list[int] = []
        held: list[str] = []
        size = 0

        def flush() -> None:
            for k, ids in zip(owner, self.known(held), strict=True):
                out[k].append(ids)
            owner.clear()
            held.clear()

        for k, text in enumerate(texts):
            for part in parts(text):
                owner.append(k)
                held.append(part)
                size += len(part)
                if size >= AT_ONCE:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]


def parts(text: str) -> Iterator[str]:
    """The text in parts of about AT_ONCE characters, cut at white space."""
    at = 0
    while at < len(text):
        space = WHITE.search(text, at + AT_ONCE)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start (the document's ids before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers), doc_tokens (with the end id), sequence_id, offset in the sequence; with_ids
    adds the piece's ids. Each id lies in one piece. Null and empty texts have the end id alone; each of the rows that
    share a doc_id is a document of its own; rows without doc_id are packed too. An empty table has no pieces. The ids
    are shuffled once, as 16-bit integers, by groups; how many is set by the bytes of text, so that a group fits a task."""
    own = texts(docs, id_col, text_col)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, told = max(1, -(-total // group_bytes)), described(path)

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = Encoder(path, told), np.array([END], "<u2").tobytes()  # what a task remembers goes with it
        for whole in batches:
            for b in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                yield batch(grp=b.column(0), doc_id=b.column(1), ids=pa.array([x + end for x in e.encode(b.column(2).to_pylist())], pa.binary()))
            release()
        del e
        loaded.cache_clear()
        release()

    dealt = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("grp"), "doc_id", "text")
    dealt = dealt.mapInArrow(tokenised, "grp long, doc_id long, ids binary")

    def packed(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("ids", "ascending")])  # the same result after a retry
        names, ids = group.column("doc_id").to_pylist(), [np.frombuffer(x, "<u2") for x in group.column("ids").to_pylist()]
        first = key[0].as_py() << 32
        rows, parts = [], []
        for k, sequence in enumerate(pack([len(x) for x in ids])):
            offset = 0
            for d, start, n in sequence:
                part = ids[d][start : start + n]
                rows.append((names[d], start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids[d]), first + k, offset))
                offset += n
                if with_ids:
                    parts.append(part)
        columns = dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), (pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), strict=True))
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts).astype(np.int32)))
        del group, ids, parts, rows
        release()
        return pa.table(columns)

    return dealt.groupBy("grp").applyInArrow(packed, PIECES + ", ids array<int>" * with_ids)

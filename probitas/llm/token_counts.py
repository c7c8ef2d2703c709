"""Operator 5: token counts with a whole-token shortcut.

Byte-level BPE splits a text into pre-tokens and merges bytes within each.  Before any text is
read, every string of the vocabulary is proved to be one pre-token by itself that merges into
its own single token; a pre-token among these counts as one token without merging.  That holds
for nearly all frequent words, so only the rest is merged, and remembered for as long as it
recurs.  Counts are exactly those of encoding the whole text.

The pre-tokens of ``PATTERN`` are found for all texts of a batch together with numpy, by the class
of each character, and hashed; only different ones are looked at one by one.  Another pattern
is matched text by text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, Pieces, mix, pieces, prefix_sums, span_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that a worker remembers before it starts over.
REMEMBERED = 1 << 19
#: Longer pre-tokens aren't remembered.
LONGEST_REMEMBERED = 64


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def merge(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The tokens of one pre-token: the adjacent pair of the lowest rank is merged until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def whole_tokens(ranks: dict[bytes, int], pattern: str = PATTERN) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and encode as their own single token."""
    import regex

    split = regex.compile(pattern)
    proved = set()
    for token, rank in ranks.items():
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if split.findall(text) == [text] and merge(ranks, token) == [rank]:
            proved.add(text)
    return frozenset(proved)


def _encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """Pre-token to number of tokens; what it lacks is merged, and remembered within bounds."""

    def __init__(self, whole: frozenset[str], encoding):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.encoding, self.most = whole, encoding, len(whole) + REMEMBERED

    def __missing__(self, word: str) -> int:
        n = len(self.encoding._encode_single_piece(word.encode()))
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[word] = n
        return n


_OTHER, _LETTER, _DIGIT, _SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class that ``PATTERN`` gives each code point."""
    import regex

    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for code, kind in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(kind, every):
            a, b = m.span()
            out[ord(every[a]) : ord(every[b - 1]) + 1] = code
    out[0xD800:0xE000] = _OTHER
    return out


def code_points(piece: Pieces) -> tuple[str, np.ndarray, np.ndarray]:
    """The text of all rows, its code points, and the first of each row with the end."""
    text = piece.data.tobytes().decode()
    before = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
    return text, np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), before[piece.offsets]


def split_points(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the matches of ``PATTERN`` begin; they are without gaps and don't cross rows."""
    size = len(points)
    kind = _classes()[points]
    new = np.zeros(size + 1, dtype=bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    start = np.flatnonzero(new[:-1])
    end = np.append(start[1:], size)
    of = kind[start]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    follows = ~edge[end]  # a run of the same row comes next
    follows[-1:] = False
    begins = np.zeros(size, dtype=bool)
    begins[start] = True
    # of white space before something else, the last character is apart, and a blank joins what follows
    spaces = np.flatnonzero((of == _SPACE) & follows)
    begins[end[spaces] - 1] = True
    blank = spaces[points[end[spaces] - 1] == 32]
    begins[end[blank]] = False
    # 's 't 'm 'd 're 've 'll, where a match begins with the apostrophe
    marks = np.flatnonzero((points[start] == 39) & (end - start == 1) & follows)
    marks = marks[begins[start[marks]] & (of[marks + 1] == _LETTER)]
    at = end[marks]
    one, two = points[at], points[np.minimum(at + 1, size - 1)] * (end[marks + 1] - at > 1)
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    short = np.isin(one, [115, 116, 109, 100])
    taken = np.where(long, 2, np.where(short, 1, 0))
    hit = taken > 0
    begins[at[hit]] = False
    rest = at[hit] + taken[hit]
    begins[rest[rest < end[marks[hit] + 1]]] = True
    return np.flatnonzero(begins)


def _token_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(mix(points.astype(np.uint64) + _U(1))), start, end)


def _hashes_of(strings: list[str]) -> np.ndarray:
    ends = np.cumsum([len(x) for x in strings])
    points = np.frombuffer("".join(strings).encode("utf-32-le"), dtype="<u4")
    return _token_hashes(points, np.concatenate([[0], ends[:-1]]), ends)


def _count(batches: Iterator[pa.RecordBatch], sent, pattern: str) -> Iterator[pa.RecordBatch]:
    vocabulary, whole = sent.value
    encoding = _encoding(load_ranks(vocabulary), pattern)
    counted = _by_batch(encoding, whole) if pattern == PATTERN else _by_text(encoding, whole, pattern)
    for batch in batches:
        for i, j, piece in pieces(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x, pa.int64()) for x in counted(piece))], names=["doc_id", "pretokens", "whole_tokens", "tokens"])


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _by_batch(encoding, whole: frozenset[str]) -> Callable[[Pieces], Counts]:
    known = np.sort(_hashes_of(list(whole)))
    merged: dict[int, int] = {}

    def counted(piece: Pieces) -> Counts:
        text, points, offsets = code_points(piece)
        if not len(points):
            return (np.zeros(len(offsets) - 1, np.int64),) * 3
        start = split_points(points, offsets)
        end = np.append(start[1:], len(points))
        different, first, which = np.unique(_token_hashes(points, start, end), return_index=True, return_inverse=True)
        single = known[np.minimum(np.searchsorted(known, different), len(known) - 1)] == different
        tokens = np.ones(len(different), dtype=np.int64)
        if len(merged) > REMEMBERED:
            merged.clear()
        for k in np.flatnonzero(~single).tolist():
            key = int(different[k])
            if (n := merged.get(key)) is None:
                n = merged[key] = len(encoding._encode_single_piece(text[start[first[k]] : end[first[k]]].encode()))
            tokens[k] = n
        heads = np.searchsorted(start, offsets)
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[which])])[heads])
        return np.diff(heads), summed(single), summed(tokens)

    return counted


def _by_text(encoding, whole: frozenset[str], pattern: str) -> Callable[[Pieces], Counts]:
    import regex

    split = regex.compile(pattern).findall
    counter = Counter(whole, encoding)

    def counted(piece: Pieces) -> Counts:
        data = piece.data.tobytes()
        words = [split(data[a:b].decode()) for a, b in zip(piece.offsets[:-1].tolist(), piece.offsets[1:].tolist(), strict=True)]
        return tuple(np.array([f(w) for w in words], dtype=np.int64) for f in (len, lambda w: sum(map(whole.__contains__, w)), lambda w: sum(map(counter.__getitem__, w))))

    return counted


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The number of tokens of each text.

    vocabulary: a file of base64 tokens and ranks, read on the driver and sent to the workers
    with the proved strings (about 2 MB; it doesn't grow with the data).  Result: doc_id,
    pretokens, whole_tokens (pre-tokens counted by the shortcut), tokens.

    A null text gives no row, an empty one a row of zeros; a null doc_id is kept as null.
    Repeated rows give a row each.  Other columns are ignored, whatever their names.  An empty
    table gives no rows.  Strings of special tokens in a text are ordinary text.
    """
    data = Path(vocabulary).read_bytes()
    sent = docs.sparkSession.sparkContext.broadcast((data, whole_tokens(load_ranks(data), pattern)))
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(
        lambda batches: _count(batches, sent, pattern), "doc_id bigint, pretokens bigint, whole_tokens bigint, tokens bigint"
    )

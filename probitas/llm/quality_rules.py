"""Operator 9: quality rules by line labelling with a linear-chain conditional random field.

Each line of a text is described by yes/no features of its shape.  A conditional random field
over the lines, decoded with Viterbi, marks each as content or boilerplate, and the share of
the words that lies in content lines decides whether the document stays.

The field is trained on a bounded sample of labelled documents with weak line labels.  Lines of
documents of quality 1 are content.  Of a document of quality 0, the lines are boilerplate
that a first fit, line by line, holds for it, and at least the one least like content: bad
documents often have a few good lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import BASE2, Pieces, pieces, prefix_sums, solid_bytes, span_hashes, words

#: Labelled documents the field is trained on, at most.
TRAINING_DOCS = 2000
CONTENT_SHARE = 0.5
_CUT = 64  # lines of a training sequence
_TOGETHER = 24  # texts that are worth a step together

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1  # upper case
_CLASS[48:58] = 2  # digits
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()?!-"]] = 3  # symbols
_CLASS[33] = 4  # exclamation
_TERMINAL = np.zeros(256, dtype=bool)
_TERMINAL[[ord(c) for c in ".?!:;\""]] = True

_BINS = {
    "words": (0.5, 2.5, 5.5, 12.5, 40.5),
    "upper": (0.1, 0.3, 0.6),
    "digits": (0.05, 0.2),
    "symbols": (0.01, 0.05, 0.15),
    "exclaimed": (0.1, 0.4),
    "distinct": (0.3, 0.55, 0.8),
    "twice": (0.1, 0.4),
    "length": (2.5, 4, 7, 10, 16),
}
_FLAGS = ("terminal", "first", "last", "again", "bias")
FEATURES = sum(len(b) + 1 for b in _BINS.values()) + len(_FLAGS)


def line_features(piece: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (a row of them for each line), words of the line, hash of the line, and the first line of each row with the end."""
    data, offsets = piece
    found = words(piece, inside=solid_bytes(data))
    starts = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
    row = np.searchsorted(offsets[1:], starts, side="right")
    inside = row < len(offsets) - 1
    starts, row = starts[inside], row[inside]
    ends = np.append(starts[1:], len(data))
    first = np.searchsorted(found.start, starts)
    last = np.append(first[1:], len(found.start))
    n = last - first
    lines = np.searchsorted(row, np.arange(len(offsets)))
    solid = found.end - found.start
    size = np.concatenate([[0], np.cumsum(solid)])
    size = np.maximum(size[last] - size[first], 1)
    kinds = _CLASS[data]
    share = {}
    for name, code in (("upper", 1), ("digits", 2), ("symbols", 3), ("exclaimed", 4)):
        sums = np.concatenate([[0], np.cumsum(kinds == code)])
        share[name] = (sums[ends] - sums[starts]) / (np.maximum(n, 1) if code == 4 else size)
    line_of = np.repeat(np.arange(len(n)), n)
    # a word is counted for its line where it is the first of equal ones
    keys = found.hash + line_of.astype(np.uint64) * BASE2
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount(line_of[order[fresh]], minlength=len(n)) / np.maximum(n, 1)
    same = np.zeros(len(found.hash) + 1, dtype=np.int64)
    if len(found.hash) > 1:
        same[2:] = np.cumsum((found.hash[1:] == found.hash[:-1]) & (line_of[1:] == line_of[:-1]))
    twice = (same[last] - same[first]) / np.maximum(n, 1)
    hashes = span_hashes(prefix_sums(found.hash), first, last)
    own = hashes + row.astype(np.uint64) * BASE2
    _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
    tail = np.where(n > 0, found.end[np.maximum(last - 1, 0)] - 1, 0) if len(found.end) else np.zeros(len(n), np.int64)
    short = n < 6
    values = {
        "words": n,
        **share,
        "distinct": np.where(short, 1.0, distinct),
        "twice": twice,
        "length": size / np.maximum(n, 1),
    }
    columns, base = [], 0
    for name, bins in _BINS.items():
        columns.append(base + np.searchsorted(bins, values[name], side="right"))
        base += len(bins) + 1
    flags = {
        "terminal": (n > 0) & (_TERMINAL[data[tail]] if len(data) else False),
        "first": np.isin(np.arange(len(n)), lines[:-1]),
        "last": np.isin(np.arange(len(n)) + 1, lines[1:]),
        "again": (counts[inverse] > 1) & (n > 0),
        "bias": np.ones(len(n), dtype=bool),
    }
    for k, name in enumerate(_FLAGS):
        columns.append(np.where(flags[name], base + k, FEATURES))
    return np.stack(columns, axis=1), n, hashes, lines


class Field:
    """A linear-chain conditional random field with the labels 0, boilerplate, and 1, content."""

    def __init__(self, emission: np.ndarray | None = None, transition: np.ndarray | None = None):
        self.emission = np.zeros(FEATURES + 1) if emission is None else emission  # of content against boilerplate
        self.transition = np.zeros((2, 2)) if transition is None else transition

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emission[features].sum(axis=1)

    def decode(self, scores: np.ndarray, before: tuple[float, float] | None = None) -> list[int]:
        """The labels of one text's lines by Viterbi; ties go to content.

        before: the scores of both labels for the line before these; its label is then the first.
        """
        (t00, t01), (t10, t11) = self.transition.tolist()
        back, (a, b) = [], before or (0.0, 0.0)
        for k, s in enumerate(scores.tolist()):
            if k or before:
                to0 = a + t00 > b + t10
                to1 = a + t01 > b + t11
                back.append((not to0, not to1))
                a, b = (a + t00 if to0 else b + t10), (a + t01 if to1 else b + t11)
            b += s
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1][: len(scores) + bool(before)]

    def decode_all(self, scores: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """``decode`` for many texts at once: text k has the lines heads[k] to heads[k + 1].

        All texts go on line by line together; the few longest, whose lines are more than those of
        nearly all others, go on alone.
        """
        (t00, t01), (t10, t11) = self.transition.tolist()
        n = np.diff(heads)
        order = np.argsort(-n, kind="stable")
        begin, n = heads[:-1][order], n[order]
        reach = np.searchsorted(-n, -np.arange(int(n[0]) + 1 if len(n) else 1), side="left")  # texts with more than so many lines
        a, b = np.zeros(len(n)), np.zeros(len(n))
        back = np.zeros((2, len(scores)), dtype=bool)
        step = 0
        while step < len(reach) and reach[step] >= _TOGETHER:
            k = reach[step]
            at = begin[:k] + step
            if step:
                x, y = a[:k].copy(), b[:k].copy()
                from0, from1 = x + t00 > y + t10, x + t01 > y + t11
                back[0, at], back[1, at] = ~from0, ~from1
                a[:k], b[:k] = np.where(from0, x + t00, y + t10), np.where(from1, x + t01, y + t11)
            b[:k] += scores[at]
            step += 1
        label = b >= a
        out = np.empty(len(scores), dtype=bool)
        for k in range(int(reach[step]) if step < len(reach) else 0):
            tail = scores[begin[k] + step : begin[k] + n[k]]
            alone = self.decode(tail, (float(a[k]), float(b[k])) if step else None)
            out[begin[k] + step : begin[k] + n[k]] = alone[1:] if step else alone
            label[k] = alone[0]
        for at_step in range(step - 1, -1, -1):
            k = reach[at_step]
            at = begin[:k] + at_step
            out[at] = label[:k]
            label[:k] = np.where(label[:k], back[1, at], back[0, at])
        return out

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.15, penalty: float = 1e-5) -> Field:
        """Maximise the penalised conditional likelihood of (features, labels) sequences with Adam."""
        longest = max(len(y) for _, y in sequences)
        x = np.concatenate([features for features, _ in sequences])
        y = np.zeros((len(sequences), longest), dtype=int)
        there = np.zeros((len(sequences), longest), dtype=bool)
        for k, (_, labels) in enumerate(sequences):
            y[k, : len(labels)], there[k, : len(labels)] = labels, True
        both = there[:, 1:] & there[:, :-1]
        weights = np.concatenate([self.emission, self.transition.ravel()])
        first = second = np.zeros_like(weights)
        total = there.sum()
        for step in range(1, steps + 1):
            emission, transition = weights[: FEATURES + 1], weights[FEATURES + 1 :].reshape(2, 2)
            score = np.zeros((*there.shape, 2))
            score[there, 1] = emission[x].sum(axis=1)  # the lines of x are in the order of there
            forward = np.zeros_like(score)
            backward = np.zeros_like(score)
            forward[:, 0] = score[:, 0]
            for t in range(1, longest):
                came = np.logaddexp(forward[:, t - 1, 0, None] + transition[0], forward[:, t - 1, 1, None] + transition[1])
                forward[:, t] = np.where(there[:, t, None], came + score[:, t], forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                ahead = score[:, t + 1] + backward[:, t + 1]
                goes = np.logaddexp(ahead[:, 0, None] + transition[:, 0], ahead[:, 1, None] + transition[:, 1])
                backward[:, t] = np.where(there[:, t + 1, None], goes, 0.0)
            whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
            content = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None])
            away = (y - content)[there]
            gradient = np.zeros_like(weights)
            gradient[: FEATURES + 1] = np.bincount(x.ravel(), weights=np.repeat(away, x.shape[1]), minlength=FEATURES + 1)
            gradient[FEATURES] = 0.0
            for i in range(2):
                for j in range(2):
                    expected = np.exp(forward[:, :-1, i] + transition[i, j] + score[:, 1:, j] + backward[:, 1:, j] - whole[:, None])
                    gradient[FEATURES + 1 + 2 * i + j] = (((y[:, :-1] == i) & (y[:, 1:] == j)) - expected)[both].sum()
            gradient = gradient / total - penalty * weights
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            weights = weights + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        return Field(weights[: FEATURES + 1], weights[FEATURES + 1 :].reshape(2, 2))


def _row_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, quality, text) to the features of the lines, a byte each."""
    for batch in batches:
        for i, j, piece in pieces(batch.column(2)):
            features, _, _, lines = line_features(piece)
            data = [features[a:b].astype(np.uint8).tobytes() for a, b in zip(lines[:-1].tolist(), lines[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(data, pa.binary())], names=["doc_id", "quality", "lines"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS) -> Field:
    """A field fitted to ``most`` labelled documents, the first by a hash of their id.

    Labels whose quality is null are left out.  Of documents with one id the smallest text
    counts.  Only the features of lines come to the driver.  Without documents of both qualities the field
    marks every line as content.
    """
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    rows = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(_row_lines, "doc_id bigint, quality int, lines binary").toArrow().sort_by("doc_id")
    quality = rows["quality"].to_numpy()
    if len(set(quality.tolist())) < 2:
        return Field()
    parts = []
    for lines, good in zip(rows["lines"], quality.tolist(), strict=True):
        features = np.frombuffer(lines.as_buffer(), dtype=np.uint8).reshape(-1, len(_BINS) + len(_FLAGS)).astype(np.int64)
        if len(features):
            parts.append((features, good))
    if not parts:
        return Field()
    alone = Field().fit([(line[None], np.array([good])) for features, good in parts for line in features])
    sequences = []
    for features, good in parts:
        scores = alone.scores(features)
        label = np.full(len(features), good) if good else ((scores > 0) & (scores > scores.min())).astype(int)
        sequences += [(features[k : k + _CUT], label[k : k + _CUT]) for k in range(0, len(label), _CUT)]
    return Field().fit(sequences)


_RESULT = "struct<lines: int, content_lines: int, content_share: double>"


def assessed(field: Field, text: Column) -> Column:
    """A struct of the number of lines, those marked as content, and the share of words in them; 0 for a text without a word."""
    emission, transition = field.emission, field.transition

    @arrow_udf(_RESULT)
    def assess(texts: pa.Array) -> pa.Array:
        fitted = Field(emission, transition)
        total, content, share = [], [], []
        for _, _, piece in pieces(texts):
            features, n, _, lines = line_features(piece)
            marks = np.concatenate([[0], np.cumsum(fitted.decode_all(fitted.scores(features), lines))])
            words_ = np.concatenate([[0], np.cumsum(n)])
            in_content = np.concatenate([[0], np.cumsum(n * np.diff(marks))])
            a, b = lines[:-1], lines[1:]
            total += (b - a).tolist()
            content += (marks[b] - marks[a]).tolist()
            share += np.round((in_content[b] - in_content[a]) / np.maximum(1, words_[b] - words_[a]), 6).tolist()
        return pa.StructArray.from_arrays([pa.array(total, pa.int32()), pa.array(content, pa.int32()), pa.array(share, pa.float64())], names=["lines", "content_lines", "content_share"])

    return assess(text)


def content_documents(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """The documents of which at least ``share`` of the words are content.

    Result: doc_id, lines, content_lines, content_share.  A null or empty text, or one of white
    space, has the share 0 and goes.  A null doc_id is kept as null.  Repeated rows are judged
    alike and all stay or all go.  Other columns are ignored, whatever their names.  An empty
    table gives no rows.
    """
    return docs.select("doc_id", assessed(field, F.col("text")).alias("found")).where(F.col("found.content_share") >= share).select("doc_id", "found.*")


def keep_content_documents(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """``docs`` without the documents that ``content_documents`` rejects; columns are unchanged, whatever their names."""
    return docs.select(F.struct("*").alias("row"), assessed(field, docs["text"]).alias("found")).where(F.col("found.content_share") >= share).select("row.*")

"""Operator 8: a quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in its features: measures of its shape, and its words and the
beginnings of its words, hashed.
P(a is preferred to b) = 1 / (1 + exp(score(b) - score(a))); the weights maximise the
likelihood of preference pairs of labelled documents, with a penalty on their squares.  A
document of quality 1 that isn't toxic is preferred to one of quality 0 or one that is toxic.

All labelled documents take part.  The weights are fitted to two thirds of them, split by a hash of
the id into blocks that one task can hold: each block is fitted by itself, with the scaling and the
vocabulary of all, and a weight is the mean of the blocks' ones, each counted as often as the
feature occurs there (Zhang, Duchi, Wainwright, Communication-efficient algorithms for statistical
optimization, 2013).  Up to ``BLOCK_DOCS`` documents are one block, which is the plain fit.

Documents stay from a score quantile on: the threshold is the ``REJECTED`` quantile of the
scores of the preferred documents among the other third.  So the share of good
documents lost is set, and that of bad ones follows from the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import _U, BASE2, Pieces, byte_values, cut, lowered, mix, pieces, prefix_sums, span_hashes, table, words
from .decontamination import _filter

#: Documents, and bytes of text, of a block that is fitted in one task, on average.
BLOCK_DOCS = 6000
BLOCK_BYTES = 1 << 24
#: Documents of either side that a block has, on average at least; scarcer ones are in several blocks.
BLOCK_SIDE = 100
#: Share of the preferred documents below the threshold.
REJECTED = 0.01
PARTNERS = 8
BITS = 18
#: Bytes of a word's beginning that are a feature, for words that are longer.
BEGINNINGS = (4, 5, 6)
#: A word counts if it is in so many of the training documents.
LEAST_DOCS = 3

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[ord(c) for c in ".,;:'\"()?!-"]] = True
SHAPES = ("upper", "digits", "odd signs", "exclamation marks", "bars", "repeated words", "equal neighbours", "word length", "log words", "distinct words", "line breaks", "full stops")


def _row_sums(values: np.ndarray, heads: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """The sum of each row's values; heads: the first value of each row, and the end."""
    sums = np.zeros(len(heads) - 1, dtype=kind)
    there = np.flatnonzero(heads[1:] > heads[:-1])
    if len(there):
        sums[there] = np.add.reduceat(values, heads[there], dtype=kind)
    return sums


def features(piece: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shape measures of each row; then bucket and weight of the features of each different word of a row, and the first feature of each row with the end."""
    data, offsets = piece
    found = words(piece)
    rows = len(offsets) - 1
    count = np.diff(found.offsets)
    row = np.repeat(np.arange(rows), count)
    size = np.maximum(np.diff(offsets), 1)
    many = np.maximum(count, 1)

    def total(marks: np.ndarray) -> np.ndarray:
        return _row_sums(marks, offsets, np.int64)

    keys = found.hash + row.astype(np.uint64) * BASE2
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    heads = np.flatnonzero(fresh)
    repeats = np.zeros(len(keys), dtype=np.int64)
    if len(heads):
        repeats[np.minimum.reduceat(order, heads)] = np.diff(np.append(heads, len(keys)))
    at = np.flatnonzero(repeats)
    times = repeats[at]
    owner = row[at]
    different = np.bincount(owner, minlength=rows)
    neighbours = np.zeros(rows)
    if len(keys) > 1:
        neighbours = np.bincount(row[1:][keys[1:] == keys[:-1]], minlength=rows)
    kinds = _CLASS[data]
    often = np.bincount(owner, weights=times * (times > 3), minlength=rows)
    shape = np.stack(
        [
            total(kinds == 1) / size,
            total(kinds == 2) / size,
            total((kinds == 3) & ~_PLAIN[data]) / size,
            total(data == 33) / many,
            total(data == 124) / many,
            often / many,
            neighbours / many,
            np.minimum((found.offsets[1:] > found.offsets[:-1]) * (size / many), 40) / 10,
            np.log1p(count) / 5,
            different / many,
            total(data == 10) / many,
            total(data == 46) / many,
        ],
        axis=1,
    )
    weight = np.log1p(times) / np.sqrt(many[owner])
    hashes, weights = [found.hash[at]], [weight]
    sums = prefix_sums(byte_values(lowered(data)))
    start, length = found.start[at], (found.end - found.start)[at]
    for beginning in BEGINNINGS:
        hashes.append(span_hashes(sums, start, start + np.minimum(length, beginning)) ^ _U(beginning << 50))
        weights.append(np.where(length > beginning, weight, 0.0))
    buckets = (np.stack(hashes, axis=1).ravel() >> _U(64 - BITS)).astype(np.int64)
    return shape, buckets, np.stack(weights, axis=1).ravel(), np.searchsorted(owner, np.arange(rows + 1)) * len(hashes)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    threshold: float

    def scores(self, piece: Pieces) -> np.ndarray:
        shape, buckets, weights, heads = features(piece)
        return np.round(((shape - self.mean) / self.scale).clip(-8, 8) @ self.shape + _row_sums(self.word[buckets] * weights, heads), 6)


class Sample(NamedTuple):
    """Features of rows: their shapes; then bucket, weight and row of each other feature, and the number of its word.

    They are in the order of rows and words; those of a word have one weight.
    """

    shape: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    row: np.ndarray
    word: np.ndarray

    def scores(self, model: Model) -> np.ndarray:
        words_ = np.bincount(self.row, weights=model.word[self.buckets] * self.weights, minlength=len(self.shape))
        return np.round(((self.shape - model.mean) / model.scale).clip(-8, 8) @ model.shape + words_, 6)


def _row_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, preferred, text) to the features, 24 bytes for each different word: the buckets of it and of its beginnings, -1 for none, and its weight."""
    each = 1 + len(BEGINNINGS)
    for batch in batches:
        for i, j, piece in pieces(batch.column(2)):
            shape, buckets, weights, heads = features(piece)
            buckets = np.where(weights > 0, buckets, -1).astype("<i4")
            parts = list(zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    batch.column(1).slice(i, j - i),
                    pa.array([x.tobytes() for x in shape], pa.binary()),
                    pa.array([buckets[a:b].tobytes() for a, b in parts], pa.binary()),
                    pa.array([weights[a:b:each].tobytes() for a, b in parts], pa.binary()),
                ],
                names=["doc_id", "preferred", "shape", "buckets", "weights"],
            )


def _text_sample(texts: pa.Array) -> Sample:
    """The features of texts, in their order."""
    parts, before = [], 0
    for i, j, piece in pieces(texts):
        shape, buckets, weights, heads = features(piece)
        there = np.flatnonzero(weights > 0)
        row = np.repeat(np.arange(i, j, dtype=np.int32), np.diff(heads))
        word = (before + there // (1 + len(BEGINNINGS))).astype(np.int32)
        parts.append(Sample(shape, buckets[there].astype("<i4"), weights[there], row[there], word))
        before += len(buckets) // (1 + len(BEGINNINGS))
    return Sample(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _sample(rows: pa.Table) -> Sample:
    flat = lambda name, kind: np.frombuffer(b"".join(x.as_buffer() for x in rows[name]), dtype=kind)
    lengths = [len(x.as_buffer()) // 4 for x in rows["buckets"]]
    buckets = flat("buckets", "<i4")
    there = np.flatnonzero(buckets >= 0)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    word = there // (1 + len(BEGINNINGS))
    return Sample(flat("shape", "<f8").reshape(-1, len(SHAPES)), buckets[there], flat("weights", "<f8")[word], row[there], word)


class Whole(NamedTuple):
    """Of all training documents: mean and spread of the shapes, and the buckets that count."""

    mean: np.ndarray
    scale: np.ndarray
    known: np.ndarray


class Terms(NamedTuple):
    """Words of rows, without the features that don't count.

    used: the buckets that count; columns: places in ``used`` of the features of each different word, one
    after the last for none; term and value: the different word and the weight of each word of a row, by row;
    heads: the first of them of each row, and the end.
    """

    used: np.ndarray
    columns: np.ndarray
    term: np.ndarray
    value: np.ndarray
    heads: np.ndarray

    def scores(self, w: np.ndarray) -> np.ndarray:
        """The sum of each row, ``w`` being of the buckets used."""
        return _row_sums(np.append(w, 0.0)[self.columns].sum(axis=0)[self.term] * self.value, self.heads)

    def gradient(self, pull: np.ndarray) -> np.ndarray:
        """What the rows' pulls add up to in each of the buckets used."""
        pulled = np.bincount(self.term, weights=np.repeat(pull, np.diff(self.heads)) * self.value, minlength=self.columns.shape[1])
        return np.bincount(self.columns.ravel(), weights=np.tile(pulled, len(self.columns)), minlength=len(self.used) + 1)[:-1]


def _terms(sample: Sample, known: np.ndarray) -> Terms:
    """A word and its beginnings have one weight in a row, so their weights are added once for each different word and not in each row."""
    keep = known[sample.buckets]
    bucket = sample.buckets[keep]
    used = np.flatnonzero(np.bincount(bucket, minlength=1 << BITS))
    place = np.zeros(1 << BITS, dtype=np.int32)
    place[used] = np.arange(len(used))
    fresh = np.diff(sample.word[keep], prepend=-1) != 0
    at = np.flatnonzero(fresh)
    value, heads = sample.weights[keep][at] * 8, np.searchsorted(sample.row[keep][at], np.arange(len(sample.shape) + 1))
    there = np.cumsum(fresh, dtype=np.int32) - 1
    columns = np.full((1 + len(BEGINNINGS), len(at)), len(used), dtype=np.int32)
    columns[np.arange(len(bucket), dtype=np.int32) - at.astype(np.int32)[there], there] = place[bucket]
    del keep, bucket, fresh, at, there
    numbers = mix(np.arange(columns.shape[0] * (len(used) + 1), dtype=np.uint64) * BASE2).reshape(columns.shape[0], -1)
    keys = sum(number[column] for number, column in zip(numbers, columns, strict=True))
    _, first, term = np.unique(keys, return_index=True, return_inverse=True)
    return Terms(used, columns[:, first].astype(np.int64), term, value, heads)


def fit(sample: Sample, preferred: np.ndarray, seed: int = 3, steps: int = 250, rate: float = 0.05, penalty: float = 3e-4, whole: Whole | None = None) -> Model:
    """Weights for the documents given; preferred is True for the better ones.  The threshold is left open.

    ``whole`` is told where they are a block of more documents.
    """
    good, bad = np.flatnonzero(preferred), np.flatnonzero(~preferred)
    rng = np.random.default_rng(seed)
    losers = np.repeat(bad, PARTNERS)
    winners = rng.choice(good, len(losers))
    if whole is None:
        whole = Whole(sample.shape.mean(axis=0), sample.shape.std(axis=0) + 1e-6, np.bincount(sample.buckets, minlength=1 << BITS) >= LEAST_DOCS)
    mean, scale, known = whole
    shape = ((sample.shape - mean) / scale).clip(-8, 8)
    terms = _terms(sample, known)
    del sample
    w = np.zeros(shape.shape[1] + len(terms.used))
    first, second = np.zeros_like(w), np.zeros_like(w)
    d = shape.shape[1]
    for step in range(1, steps + 1):
        score = shape @ w[:d] + terms.scores(w[d:])
        push = 1 / (1 + np.exp(np.clip(score[winners] - score[losers], -30, 30))) / len(losers)
        pull = np.bincount(winners, weights=push, minlength=len(shape)) - np.bincount(losers, weights=push, minlength=len(shape))
        gradient = np.concatenate([shape.T @ pull, terms.gradient(pull)]) - penalty * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w = w + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    word = np.zeros(1 << BITS)
    word[terms.used] = w[d:] * 8
    return Model(mean, scale, w[:d], word, -np.inf)


#: Slots of sums beside the buckets: documents, preferred ones, bytes, then the shapes and their squares.
_BESIDE = 3 + 2 * len(SHAPES)
#: Sums are of integers, so they don't depend on the order: fractions of shapes, and of weights.
_PARTS, _FINE = 1 << 24, 1 << 32


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(preferred, text) to the sums of a partition: slot, total."""
    sums = np.zeros((1 << BITS) + _BESIDE, dtype=np.int64)
    beside = sums[1 << BITS :]
    for batch in batches:
        beside[0] += len(batch)
        beside[1] += np.count_nonzero(batch.column(0))
        for _, _, piece in pieces(batch.column(1)):
            shape, buckets, weights, _ = features(piece)
            sums[: 1 << BITS] += np.bincount(buckets[weights > 0], minlength=1 << BITS)
            beside[2] += len(piece.data)
            beside[3:] += np.rint(np.concatenate([shape, shape**2], axis=1) * _PARTS).astype(np.int64).sum(axis=0)
    slot = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sums[slot])], names=["slot", "total"])


def _fit_block(rows: pa.Table, whole: Whole) -> pa.Table:
    """(place, preferred, text) of a block to its weights times their occurrences: slot, product, times."""
    rows = rows.sort_by("place")
    preferred = rows["preferred"].to_numpy()
    if not preferred.any() or preferred.all():
        return pa.table({x: pa.array([], pa.int64()) for x in ("slot", "product", "times")})
    samples = [_text_sample(rows["text"])]
    occur = np.bincount(samples[0].buckets, minlength=1 << BITS)
    model = fit(samples.pop(), preferred, whole=whole)  # not held here, so that fit can let go of it
    used = np.flatnonzero((occur > 0) & whole.known)
    times = np.concatenate([occur[used], np.full(len(SHAPES), len(rows))])
    product = np.rint(np.concatenate([model.word[used], model.shape]) * _FINE).astype(np.int64) * times
    return pa.table({"slot": np.concatenate([used, (1 << BITS) + np.arange(len(SHAPES))]), "product": product, "times": times})


def _at_rank(keys: DataFrame, rank: int) -> int:
    """The key of the rank, from 0, in the one column ``key`` of integers; at most 65,536 of them, or counts of as many, come to the driver."""
    for shift in (48, 32, 16, 0):
        part = F.shiftright("key", shift)
        counts = keys.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("part")
        n = counts["n"].to_numpy()
        k = int(np.searchsorted(np.cumsum(n), rank, side="right"))
        rank -= int(n[:k].sum())
        keys = keys.where(part == counts["part"][k].as_py())
        if n[k] <= 1 << 16:
            break
    else:
        return counts["part"][k].as_py()
    return int(np.sort(keys.toArrow()["key"].to_numpy())[rank])


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, preferred, text, place) of each document with a label.  Texts without one aren't shuffled, but for those that a Bloom filter of bounded size lets pass."""
    chosen = cut(
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("preferred"))
    )
    sent = docs.sparkSession.sparkContext.broadcast(_filter(chosen.select(F.xxhash64("doc_id").alias("key"))))

    @arrow_udf("boolean")
    def has_label(keys: pa.Array) -> pa.Array:
        return pa.array(sent.value.has(keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(has_label(F.xxhash64("doc_id")))
    return texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("preferred").alias("preferred"), F.min("text").alias("text")).withColumn("place", F.xxhash64("doc_id"))


def train(docs: DataFrame, labels: DataFrame, most: int | None = None, held_out: int | None = None, rejected: float = REJECTED, block: int = BLOCK_DOCS) -> Model:
    """Fit the weights to two thirds of the labelled documents, the first by a hash of their id, and the threshold to the others.

    All of them count, unless ``most`` and ``held_out`` bound the two; ``block`` is how many are fitted in one task.
    Labels with a null id or quality are left out; a null toxic counts as 0.  Of documents with
    one id the smallest text counts.  Neither texts nor features come to the driver, but sums by bucket.  Without documents
    on both sides all scores are 0 and all documents stay.  Without preferred documents held
    out, the threshold is found on the training documents.
    """
    empty = Model(np.zeros(len(SHAPES)), np.ones(len(SHAPES)), np.zeros(len(SHAPES)), np.zeros(1 << BITS), -np.inf)
    rows, remove = table(_labelled(docs, labels))
    try:
        return _trained(rows, empty, most, held_out, rejected, block)
    finally:
        remove()


def _trained(rows: DataFrame, empty: Model, most: int | None, held_out: int | None, rejected: float, block: int) -> Model:
    number = rows.count()
    if not number:
        return empty
    n = min(number if most is None else most, max(2 * number // 3, 1))
    places = rows.select(F.col("place").alias("key"))
    last = _at_rank(places, n - 1)
    training, rest = rows.where(F.col("place") <= last), rows.where(F.col("place") > last)
    if held_out is not None and n + held_out < number:
        rest = rest.where(F.col("place") <= _at_rank(places, n + held_out - 1))

    found = training.select("preferred", "text").mapInArrow(_totals, "slot bigint, total bigint").groupBy("slot").agg(F.sum("total").alias("total"))
    found = found.where((F.col("slot") >= 1 << BITS) | (F.col("total") >= LEAST_DOCS)).toArrow()
    sums = np.zeros((1 << BITS) + _BESIDE, dtype=np.int64)
    sums[found["slot"].to_numpy()] = found["total"].to_numpy()
    good, size = int(sums[(1 << BITS) + 1]), int(sums[(1 << BITS) + 2])
    if good in (0, n):
        return empty
    mean, square = np.split(sums[(1 << BITS) + 3 :] / (n * _PARTS), 2)
    whole = Whole(mean, np.sqrt(np.maximum(square - mean**2, 0)) + 1e-6, sums[: 1 << BITS] > 0)

    blocks = max(-(-n // block), -(-size // BLOCK_BYTES))
    copies = lambda side: min(blocks, -(-blocks * BLOCK_SIDE // side))
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("preferred"), copies(good)).otherwise(copies(n - good)) - 1))
    weights = (
        training.select("place", "preferred", "text", copy.alias("copy"))
        .withColumn("block", F.pmod(F.xxhash64("place") + F.col("copy"), F.lit(blocks)))
        .groupBy("block")
        .applyInArrow(lambda part: _fit_block(part, whole), "slot bigint, product bigint, times bigint")
        .groupBy("slot")
        .agg(F.sum("product").alias("product"), F.sum("times").alias("times"))
        .toArrow()
    )
    weight = np.zeros((1 << BITS) + len(SHAPES))
    weight[weights["slot"].to_numpy()] = weights["product"].to_numpy() / (weights["times"].to_numpy() * float(_FINE))
    model = Model(whole.mean, whole.scale, weight[1 << BITS :], weight[: 1 << BITS], -np.inf)

    for part in (rest, training):
        scores = cut(part.where("preferred").select(F.rint(scored(part, model, F.col("text")) * 1_000_000).cast("bigint").alias("key")))
        if count := scores.count():
            break
    return model._replace(threshold=_at_rank(scores, int(rejected * (count - 1))) / 1e6)


def scored(docs: DataFrame, model: Model, text: Column) -> Column:
    """The score of a text, rounded to 6 digits."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(sent.value.scores(piece) for _, _, piece in pieces(texts))]))

    return score(text)


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score reaches the model's threshold: doc_id, score.

    A null text is scored as an empty one; an empty text has no words, so only its shape
    counts.  A null doc_id is kept as null.  Repeated rows have one score and all stay or all
    go; a score equal to the threshold stays.  Other columns are ignored, whatever their names.
    An empty table gives no rows.
    """
    return docs.select("doc_id", scored(docs, model, F.col("text")).alias("score")).where(F.col("score") >= model.threshold)



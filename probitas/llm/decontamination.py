"""Operator 6: benchmark decontamination by template canonicalisation.

A text becomes a sequence of words in lower case in which numbers, names and units are
placeholders of their type.  Windows of ``WINDOW`` template words are hashed and joined with
the windows of the benchmark.  Windows of one text and one item that lie on the same diagonal
form an alignment; it counts only if the values in its slots are consistent, i.e. a value of
the item always stands for the same value of the text and the other way round.  So a question
whose numbers and names were replaced throughout is caught, and a chance run of placeholders
isn't.

- number: digits, also with . or , between them, and written-out numbers of ``NUMBERS``;
- unit: a word of ``UNITS`` right behind a number, also if glued to it;
- name: told in two ways, so there are two template readings of a text.  By vocabulary: a
  word that no item has but capitalised.  This asks nothing of the text's own case and of
  sentences and needs no list, so names may be new, open a sentence or stand in lower or
  upper case; but a name that some item also has as a common word isn't seen.  By capitals:
  capitalised words within a sentence that aren't among ``PLAIN``, and capitalised given names
  of ``NAMES`` anywhere, which sees such names.  A run of names is one name.

A third reading leaves all words as they are, so a copy word for word is found whatever its
words are.  Windows are joined within a reading, and the one with the largest coverage counts.

An item contaminates a text if at least ``COVERAGE`` of the item's windows of a reading are
matched by alignments whose diagonals are less than ``DRIFT`` words apart, i.e. in one place of the
text.  Windows of templates with fewer than half literal words aren't used, nor, where the
vocabulary tells names, those with names and fewer than ``LEAST`` literal words; the reading
without placeholders uses all.  Items of fewer than ``WINDOW`` words are one window of their own size.
An item of fewer than ``LEAST`` words is found where it is a whole line of a text; within lines such
few words are no sign of a copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, Pieces, Words, cut, lowered, mix, pieces, prefix_sums, signed, span_hashes, with_row_key, words

WINDOW = 8
LEAST = 4
COVERAGE = 0.4
DRIFT = 32

LITERAL, NUMBER, NAME, UNIT = range(4)
PLAIN_READING, BY_CAPITALS, BY_VOCABULARY = range(3)
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz pound pounds ounce ounces gram grams kilogram "
    "kilograms ton tons ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years hz khz mhz ghz w kw kwh v a j kj cal kcal c f k degrees degree percent b kb mb gb tb usd eur gbp "
    "dollar dollars cent cents euro euros kph mph km2 m2 m3"
).split()
NAMES = (
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew kenneth george kevin "
    "brian edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott frank raymond samuel tom tim "
    "jim bob joe ben sam max leo adam alex peter henry jack luke oscar carlos juan jose luis pedro pierre jean hans klaus mary patricia "
    "jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty sandra ashley emily kimberly donna michelle carol amanda "
    "melissa deborah stephanie laura anna ann anne amy kate emma olivia sophia julia maria jane alice lucy grace rachel maya natalia janet "
    "sofia camille elena ingrid weng"
).split()
#: Never names, however they are written: words that often begin a sentence or a line.
PLAIN = (
    "a an the this that these those i he she it we you they his her its our their my your in on at by for from to of with without and or but if "
    "when while what which who whom whose where why how is are was were do does did has have had can could will would should may might must not no "
    "yes all any each every some one after before as so then than there here let given suppose find calculate"
).split()

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SENTENCE = np.zeros(256, dtype=bool)
_SENTENCE[[10, 33, 46, 58, 63]] = True
_SLOT = mix(np.arange(1, 5, dtype=np.uint64))
#: Bits of a filter: 64 for each key, within these bounds; the largest takes 64 MB.
_FEWEST_BITS, _MOST_BITS = 22, 29


@lru_cache(maxsize=1)
def _lists() -> tuple[np.ndarray, ...]:
    def hashes(list_: list[str]) -> np.ndarray:
        data = np.frombuffer(" ".join(list_).encode(), dtype=np.uint8)
        return np.sort(words(Pieces(data, np.array([0, len(data)]))).hash)

    return tuple(hashes(x) for x in (NUMBERS, UNITS, NAMES, PLAIN))


def _among(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return of[at] == x


class Filter(NamedTuple):
    """A Bloom filter of two hashes over 64-bit keys that are hashes themselves."""

    bits: int
    marks: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        low = _U((1 << self.bits) - 1)
        found = np.ones(len(keys), dtype=bool)
        for slot in (keys & low, (keys >> _U(_MOST_BITS)) & low):
            found &= ((self.marks[slot >> _U(6)] >> (slot & _U(63))) & _U(1)).astype(bool)
        return found


def _filter(keys: DataFrame) -> Filter:
    """The filter of the one column of ``keys``, put together on the executors; its size is bounded."""
    [name] = keys.columns
    bits = min(max((64 * keys.count()).bit_length(), _FEWEST_BITS), _MOST_BITS)
    low = (1 << bits) - 1
    slots = F.array(F.col(name).bitwiseAND(F.lit(low)), F.shiftrightunsigned(name, _MOST_BITS).bitwiseAND(F.lit(low)))
    found = (
        keys.select(F.explode(slots).alias("slot"))
        .groupBy(F.shiftrightunsigned("slot", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("marks"))
        .toArrow()
    )
    marks = np.zeros(1 << (bits - 6), dtype=np.uint64)
    marks[found["at"].to_numpy()] = found["marks"].to_numpy().view(np.uint64)
    return Filter(bits, marks)


class Reading(NamedTuple):
    """Template word, kind and value of each word or slot; offsets: the first of each row, and the end."""

    template: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    offsets: np.ndarray


class Written(NamedTuple):
    """The words of a piece and how they are written.  capital: a capital and then no other; opens: at the start of a sentence or row; head: of a row."""

    piece: Pieces
    found: Words
    number: np.ndarray
    unit: np.ndarray
    capital: np.ndarray
    opens: np.ndarray
    head: np.ndarray


def written(piece: Pieces) -> Written:
    data = piece.data
    digit = _DIGIT[data]
    glued = np.flatnonzero(digit[:-1] & ~digit[1:]) + 1
    low = lowered(data)
    found = words(piece, low=low, breaks=glued)
    start, end, n = found.start, found.end, len(found.hash)
    head = np.zeros(n, dtype=bool)
    head[found.offsets[:-1][np.diff(found.offsets) > 0]] = True
    if not n:
        return Written(piece, found, head, head, head, head, head)
    numbers, units, _, _ = _lists()
    digits = np.concatenate([[0], np.cumsum(digit)])
    number = (digits[end] - digits[start] == end - start) | _among(found.hash, numbers)
    unit = np.concatenate([[False], number[:-1]]) & ~head & ~number & _among(found.hash, units)
    breaks = np.concatenate([[0], np.cumsum(_SENTENCE[data])])
    opens = head | (breaks[start] > breaks[np.concatenate([[0], end[:-1]])])
    changed = np.concatenate([[0], np.cumsum(low != data)])
    first = np.where(data[start] == 0xC3, 2, 1)
    within = np.minimum(start + first, end)
    capital = (changed[within] > changed[start]) & (changed[end] == changed[within]) & (end > within)
    return Written(piece, found, number, unit, capital, opens, head)


def _reading(w: Written, name: np.ndarray, apart: np.ndarray) -> Reading:
    """The reading with these names; a run of names is one unless a name stands ``apart``, and 1,000 and 3.5 are one number."""
    found, n = w.found, len(w.found.hash)
    kind = np.zeros(n, dtype=np.int8)
    kind[name], kind[w.unit], kind[w.number] = NAME, UNIT, NUMBER
    gap = found.start - np.concatenate([[0], found.end[:-1]])
    point = np.isin(w.piece.data[np.maximum(found.start - 1, 0)], [44, 46])
    follows = np.concatenate([[False], kind[1:] == kind[:-1]]) & ~w.head
    joined = follows & (((kind == NUMBER) & (gap == 1) & point & _DIGIT[w.piece.data[found.start]]) | ((kind == NAME) & ~apart))
    keep = np.flatnonzero(~joined)
    value = span_hashes(prefix_sums(found.hash), keep, np.append(keep[1:], n))
    kind = kind[keep]
    return Reading(np.where(kind == LITERAL, value, _SLOT[kind]), kind, value, np.searchsorted(keep, found.offsets))


def readings(w: Written, vocabulary: Filter, wanted: tuple[int, ...] = (PLAIN_READING, BY_CAPITALS, BY_VOCABULARY)) -> dict[int, Reading]:
    found, n = w.found, len(w.found.hash)
    out = {}
    if not n or PLAIN_READING in wanted:
        out[PLAIN_READING] = Reading(found.hash, np.zeros(n, np.int8), found.hash, found.offsets)
    if not n:
        return dict.fromkeys(wanted, out[PLAIN_READING])
    if BY_CAPITALS in wanted:
        _, _, names, plain = _lists()
        out[BY_CAPITALS] = _reading(w, w.capital & ~w.number & (~w.opens | _among(found.hash, names)) & ~_among(found.hash, plain), w.opens)
    if BY_VOCABULARY in wanted:
        out[BY_VOCABULARY] = _reading(w, ~w.number & ~w.unit & ~vocabulary.has(found.hash), w.head)
    return out


def _common_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of items that are written as common ones at least once."""
    plain = _lists()[3]
    for batch in batches:
        for _, _, piece in pieces(batch.column(0)):
            w = written(piece)
            common = ~w.number & ~w.unit & (~w.capital | _among(w.found.hash, plain))
            yield pa.RecordBatch.from_arrays([signed(np.unique(w.found.hash[common]))], names=["word"])


def _windows(template: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and hash of every window of ``size`` template words."""
    number = np.maximum(np.diff(offsets) - size + 1, 0)
    row = np.repeat(np.arange(len(number)), number)
    start = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + offsets[row]
    return row, start, span_hashes(prefix_sums(template), start, start + size)


def _lists_of(values: np.ndarray, start: np.ndarray, size: int) -> pa.Array:
    taken = values[start[:, None] + np.arange(size)] if len(start) else values[:0]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(start) * size + 1, size, dtype=np.int32)), pa.array(taken.ravel()))


def _count_of(kind: np.ndarray, what: int, start: np.ndarray, size: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(kind == what)])
    return sums[start + size] - sums[start]


def _item_windows(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, piece in pieces(batch.column(2)):
            for reading, (template, kind, value, offsets) in readings(written(piece), vocabulary.value).items():
                sizes = np.minimum(np.diff(offsets), WINDOW)
                for size in np.unique(sizes[sizes >= (1 if reading == PLAIN_READING else LEAST)]).tolist():
                    row, start, key = _windows(template, offsets, size)
                    literal = _count_of(kind, LITERAL, start, size)
                    keep = (sizes[row] == size) & (2 * literal >= size)
                    if reading == BY_VOCABULARY:
                        keep &= (literal >= LEAST) | (_count_of(kind, NAME, start, size) == 0)
                    row, start, key = row[keep], start[keep], key[keep]
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, j - i).take(rows),
                            batch.column(1).slice(i, j - i).take(rows),
                            pa.array(np.full(len(row), reading, dtype=np.int32)),
                            pa.array(np.full(len(row), size, dtype=np.int32)),
                            signed(key),
                            pa.array((start - offsets[row]).astype(np.int32)),
                            pa.array(np.bincount(row, minlength=j - i)[row].astype(np.int32)),
                            _lists_of(kind.astype(np.int32), start, size),
                            _lists_of(value.view(np.int64), start, size),
                        ],
                        names=["item_id", "item_key", "reading", "size", "window", "item_pos", "total", "kinds", "item_values"],
                    )


_ITEM = "item_id bigint, item_key bigint, reading int, size int, window bigint, item_pos int, total int, kinds array<int>, item_values array<bigint>"


def _text_windows(batches: Iterator[pa.RecordBatch], shapes: list[tuple[int, int]], vocabulary, known) -> Iterator[pa.RecordBatch]:
    """The windows of texts that pass the filter of the benchmark's windows."""
    wanted = tuple({reading for reading, _ in shapes})
    for batch in batches:
        for i, j, piece in pieces(batch.column(2)):
            w = written(piece)
            read = readings(w, vocabulary.value, wanted)
            for reading, size in shapes:
                template, _, value, offsets = read[reading]
                row, start, key = _windows(template, offsets, size)
                maybe = np.flatnonzero(known.value.has(key))
                if len(maybe) and size < LEAST:
                    # the words of a whole line; words are those of the plain reading here
                    line = np.concatenate([[0], np.cumsum(piece.data == 10)])[w.found.start]
                    breaks = np.concatenate([[True], line[1:] > line[:-1], [True]])
                    breaks[offsets] = True
                    maybe = maybe[breaks[start[maybe]] & breaks[start[maybe] + size]]
                    inner = np.concatenate([[0], np.cumsum(breaks)])
                    maybe = maybe[inner[start[maybe] + size] - inner[start[maybe]] == 1]
                row, start, key = row[maybe], start[maybe], key[maybe]
                if not len(row):
                    continue
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).take(rows),
                        batch.column(1).slice(i, j - i).take(rows),
                        pa.array(np.full(len(row), reading, dtype=np.int32)),
                        pa.array(np.full(len(row), size, dtype=np.int32)),
                        signed(key),
                        pa.array((start - offsets[row]).astype(np.int32)),
                        _lists_of(value.view(np.int64), start, size),
                    ],
                    names=["doc_id", "row_key", "reading", "size", "window", "pos", "values"],
                )


_TEXT = "doc_id bigint, row_key bigint, reading int, size int, window bigint, pos int, values array<bigint>"


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a text and a benchmark item that it contains, verbatim or re-parameterised.

    Result: doc_id, row_key, item_id, windows (matched windows of the item), coverage (their
    share), verbatim (no slot has another value).

    Rows of either table whose id or text is null take no part; an empty text has no windows.
    Repeated rows count once.  Items that share an id but not a text are searched for
    separately, and the one with the largest coverage is reported for the id.  Other columns
    are ignored, whatever their names.  An empty table on either side gives no rows.

    Two Bloom filters of bounded size are sent to the executors, one of the benchmark's common
    words and one of its windows; windows of texts that pass are joined with the benchmark's, so a
    false positive costs a row and changes nothing.
    """
    send = docs.sparkSession.sparkContext.broadcast
    source = with_row_key(docs, "text")
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.xxhash64("text").alias("item_key"), "text").distinct()
    vocabulary = send(_filter(cut(items.select("text").mapInArrow(_common_words, "word bigint").distinct())))
    items = cut(items.mapInArrow(lambda batches: _item_windows(batches, vocabulary), _ITEM))
    shapes = sorted((r.reading, r.size) for r in items.select("reading", "size").distinct().collect())  # of 3 readings and WINDOW sizes
    known = send(_filter(items.select("window")))
    found = source.mapInArrow(lambda batches: _text_windows(batches, shapes, vocabulary, known), _TEXT).join(items, ["reading", "size", "window"])
    slots = F.filter(F.arrays_zip("kinds", "item_values", "values"), lambda s: s["kinds"] > 0)
    different = lambda *fields: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kinds"], *(s[f] for f in fields)))))
    place = lambda shift: F.struct(F.lit(shift).alias("grid"), F.floor((F.col("diagonal") + shift) / (2 * DRIFT)).alias("cell"))
    # two grids of cells, so diagonals less than DRIFT apart lie in one cell of one of them
    return (
        found.groupBy("doc_id", "row_key", "item_id", "item_key", "reading", "total", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
        .agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"))
        .where((F.size("slots") == different("item_values")) & (F.size("slots") == different("values")))
        .select("*", F.forall("slots", lambda s: s["item_values"] == s["values"]).alias("same"), F.explode(F.array(place(0), place(DRIFT))).alias("place"))
        .groupBy("doc_id", "row_key", "item_id", "item_key", "reading", "total", "place")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("windows"), F.min("same").alias("verbatim"))
        .withColumn("coverage", F.round(F.col("windows") / F.col("total"), 6))
        .where(F.col("coverage") >= coverage)
        .groupBy("doc_id", "row_key", "item_id")
        .agg(F.max(F.struct("coverage", "windows", "verbatim")).alias("best"))
        .select("doc_id", "row_key", "item_id", "best.windows", "best.coverage", "best.verbatim")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the texts that contain a benchmark item; columns and other rows are unchanged."""
    gone = contaminated(docs, benchmark, coverage).select("doc_id", "row_key").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("row_key"))
    return keyed.join(gone, ["doc_id", "row_key"], "left_anti").select("row.*")

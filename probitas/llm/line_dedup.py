"""Operator 1: near-duplicate lines by a deletion-neighbourhood join.

A line is the text between two newlines; its words are the runs without white space, in
lower case; in scripts that don't part words (Chinese, Japanese, Thai) every character is one.  Two
lines match if they have the same words, or if the word edit distance is 1, one word inserted,
deleted or replaced, and both have at least ``near_words`` words, so that one edit is at most
1 / near_words of a line.  Every line that matches an earlier one is dropped, whatever its
length; "earlier" compares the first occurrences by (doc_id, row_key, line number).

The deletion neighbourhood of a line is the line itself and the line without its i-th word,
for every i.  Two lines are within one edit only if their neighbourhoods meet, so an equi-join
of hashed neighbours finds all pairs.  Emitting the neighbours of all lines would shuffle some
fifty keys a line, so lines are sieved before: if one word differs, the first or the last half
of the words is the same (pigeonhole), so a line that shares neither half with any other
distinct line has no partner.  The sieve loses no pair.  The halves are rounded down to a few
lengths, so that nearly all lines have the same ones whether they are the longer or the shorter
of a pair.  The word lists of all pairs found are
compared before a line is dropped, so hash collisions drop nothing.

Within a bucket of equal neighbours, lines of one length that lack the same position are
within one edit of each other, so linking each to the earliest is exact, and the number of
links grows linearly with the lines, whatever a bucket's size.

The earliest match of a line may have an earlier match itself.  Such chains are followed to
their end, a line that stays, by doubling the steps, so the rounds grow with the logarithm of the
longest chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    BASE,
    BASE2,
    BASE_INV,
    _U,
    cut,
    mix,
    pieces,
    powers,
    prefix_sums,
    signed,
    solid_bytes,
    span_hashes,
    table,
    with_row_key,
    words,
)

NEAR_WORDS = 8
LINE_BYTES = np.uint8(10)
_BASE2_INV = _U(pow(int(BASE2), -1, 1 << 64))
_HALVES = ("h0", "h1", "h2", "h3")


def _words(piece):
    """The runs without white space; a character of U+3000 to U+9FFF or of Thai is a word by itself."""
    data = piece.data
    alone = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
    thai = np.flatnonzero(data[:-1] == 0xE0)
    alone = np.concatenate([alone, thai[(data[thai + 1] == 0xB8) | (data[thai + 1] == 0xB9)]])
    return words(piece, inside=solid_bytes(data), low=data, breaks=np.concatenate([alone, alone + 3]))


def _lines(piece):
    """Words of a piece of texts and, for each line: its row, number in the row and range of words."""
    found = _words(piece)
    breaks = np.flatnonzero(piece.data == LINE_BYTES) + 1
    starts = np.union1d(piece.offsets[:-1], breaks)
    filled = np.diff(piece.offsets) > 0
    row = np.searchsorted(piece.offsets[1:], starts, side="right")
    inside = row < len(filled)
    starts, row = starts[inside], row[inside]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    first = np.searchsorted(found.start, starts)
    last = np.append(first[1:], len(found.start))
    return found, row, number, first, last


_LENGTHS = np.unique([k << e for e in range(40) for k in (1, 5, 6, 7)])


def _half(n: np.ndarray) -> np.ndarray:
    """The largest of _LENGTHS that is at most n / 2."""
    return _LENGTHS[np.searchsorted(_LENGTHS, np.maximum(n // 2, 1), side="right") - 1]


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row_key, text) to the hashes of each line that has a word."""
    for batch in batches:
        for i, j, piece in pieces(batch.column(2)):
            found, row, number, first, last = _lines(piece)
            n = last - first
            keep = np.flatnonzero(n)
            if not len(keep):
                continue
            row, number, first, last, n = (x[keep] for x in (row, number, first, last, n))
            sums = prefix_sums(found.hash)
            key = span_hashes(sums, first, last)
            check = span_hashes(prefix_sums(found.hash, BASE2), first, last, _BASE2_INV)
            halves = []
            longer = _half(n)  # as the shorter or equal line of a pair
            for half in (longer, _half(n - 1)):  # and as the longer
                same = (half == longer) & bool(halves)
                halves.append(pa.array(span_hashes(sums, first, first + half).view(np.int64), mask=same))
                halves.append(pa.array(mix(span_hashes(sums, last - half, last)).view(np.int64), mask=same))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i).take(at),
                    batch.column(1).slice(i, j - i).take(at),
                    pa.array(number.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    signed(key),
                    signed(check),
                    *halves,
                ],
                names=["doc_id", "row_key", "line_no", "n", "key", "check", *_HALVES],
            )


_KEYS = "doc_id bigint, row_key bigint, line_no int, n int, key bigint, check bigint, " + ", ".join(f"{h} bigint" for h in _HALVES)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, line) to the hashes of the line's neighbours; pos is -1 for the line itself."""
    for batch in batches:
        for i, j, piece in pieces(batch.column(1)):
            found = _words(piece)
            first, last = found.offsets[:-1], found.offsets[1:]
            n = last - first
            sums = prefix_sums(found.hash)
            whole = span_hashes(sums, first, last)
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row))
            # the words behind the gap count one power less
            rest = (sums[at] - sums[first[row]]) + (sums[last[row]] - sums[at + 1]) * BASE_INV
            gap = mix(rest * powers(BASE_INV, len(sums))[first[row]] + (n[row] - 1).astype(np.uint64) * BASE2)
            rows = pa.array(np.concatenate([np.arange(len(n)), row]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i).take(rows),
                    pa.array(np.concatenate([n, n[row]]).astype(np.int32)),
                    pa.array(np.concatenate([np.full(len(n), -1), at - first[row]]).astype(np.int32)),
                    signed(np.concatenate([whole, gap])),
                ],
                names=["at", "n", "pos", "neighbour"],
            )


def _at() -> Column:
    return F.struct("doc_id", "row_key", "line_no").alias("at")


_AT = "struct<doc_id: bigint, row_key: bigint, line_no: int>"


_ALONE = r"\x{E00}-\x{E7F}\x{3000}-\x{9FFF}"
WORD = rf"[{_ALONE}]|[^ \t\r\f\x0B{_ALONE}]+"


def word_list(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether word lists of lengths that differ by 0 or 1 are one edit apart; a isn't longer than b."""
    n = F.size(a)
    same_head = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) != F.element_at(b, i))), n + 1)
    rest = lambda x: F.slice(x, same_head + 1, F.size(x))
    return F.when(n == F.size(b), rest(a) == rest(b)).otherwise(F.slice(a, same_head, n) == rest(b))


def _ends(near: DataFrame) -> DataFrame:
    """(at, near, edits): each line's match replaced by the end of the chain of matches that it begins."""
    near = cut(near)
    while not near.join(near.select(F.col("at").alias("near")), "near", "left_semi").isEmpty():
        on = near.select(F.col("at").alias("near"), F.col("near").alias("further"), F.col("edits").alias("more"))
        near = cut(near.join(on, "near", "left").select("at", F.coalesce("further", "near").alias("near"), (F.col("edits") + F.coalesce("more", F.lit(0))).alias("edits")))
    return near


def repeated_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """The lines that match an earlier line.

    Result: doc_id, row_key, line_no (from 0), kept_doc_id, kept_row_key, kept_line_no: the
    line that stays for it, which is found by going to the earliest match again and again;
    and edits, the steps of one word edit that lead there, 0 where the words are the same.

    Rows whose doc_id or text is null take no part.  Lines without a word, so empty texts too,
    are never dropped.  Repeated rows (same id and text) are one row: what
    is dropped of one is dropped of all.  Ties can't occur between distinct lines.  Columns
    other than doc_id and text are ignored, whatever their names.  An empty table gives no rows.
    """
    return _repeated_lines(docs, near_words)[0]


def _repeated_lines(docs: DataFrame, near_words: int) -> tuple[DataFrame, Callable[[], None]]:
    """``repeated_lines``, and a function that removes the table that it reads."""
    source = with_row_key(docs, F.lower("text").alias("text"))
    lines = source.mapInArrow(_line_keys, _KEYS)
    distinct, remove = table(
        lines.groupBy("key", "check").agg(
            F.min(_at()).alias("at"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), *(F.min(h).alias(h) for h in _HALVES)
        )
    )
    halves = distinct.where(F.col("n") >= near_words).select("at", F.explode(F.array_compact(F.array(*_HALVES))).alias("half"))
    shared = (
        halves.withColumn("lines", F.count(F.lit(1)).over(Window.partitionBy("half")))
        .where("lines > 1")
        .groupBy("at.doc_id", "at.row_key")
        .agg(F.collect_set("at.line_no").alias("numbers"))
    )
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    candidates = cut(
        shared.join(source, ["doc_id", "row_key"])
        .select("doc_id", "row_key", F.inline(F.filter(numbered, lambda x: F.array_contains("numbers", x["line_no"]))))
        .select(_at(), "line"),
        free=True,
    )
    neighbours = candidates.mapInArrow(_neighbours, f"at {_AT}, n int, pos int, neighbour bigint")
    bucket = Window.partitionBy("neighbour")
    # Links to the earliest that lacks the same position, to the earliest longer line, and to the one line that is the neighbour itself.
    longer = F.min(F.when(F.col("pos") >= 0, F.col("at"))).over(bucket)
    itself = F.min(F.when(F.col("pos") < 0, F.col("at"))).over(bucket)
    alike = F.min("at").over(Window.partitionBy("neighbour", "n", "pos"))
    pairs = (
        neighbours.select("at", "pos", "neighbour", alike.alias("alike"), longer.alias("longer"), itself.alias("itself"))
        .select("at", F.explode(F.array(F.when(F.col("pos") >= 0, F.col("alike")), F.when(F.col("pos") < 0, F.col("longer")).otherwise(F.col("itself")))).alias("early"))
        .where("early < at")
        .distinct()
    )
    line = lambda c, name: candidates.select(F.col("at").alias(c), word_list(F.col("line")).alias(name))
    a, b = F.col("words"), F.col("early_words")
    near = (
        pairs.join(line("at", "words"), "at")
        .join(line("early", "early_words"), "early")
        .where(F.abs(F.size(a) - F.size(b)) <= 1)
        .where(F.when(F.size(a) <= F.size(b), _within_one_edit(a, b)).otherwise(_within_one_edit(b, a)))
        .groupBy("at")
        .agg(F.min("early").alias("near"), F.lit(1).alias("edits"))
    )
    keepers = (
        distinct.select("key", "check", "at", "copies")
        .join(_ends(near), "at", "left")
        .where((F.col("copies") > 1) | F.col("near").isNotNull())
        .select("key", "check", F.coalesce("near", "at").alias("kept"), F.coalesce("edits", F.lit(0)).alias("edits"))
    )
    found = (
        lines.select("key", "check", _at())
        .join(keepers, ["key", "check"])
        .where("at <> kept")
        .select(
            "at.*",
            F.col("kept.doc_id").alias("kept_doc_id"),
            F.col("kept.row_key").alias("kept_row_key"),
            F.col("kept.line_no").alias("kept_line_no"),
            "edits",
        )
        .distinct()
    )
    return found, remove


def drop_repeated_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` without the lines that match an earlier line.

    All columns are kept; n_chars, where there is one, is set to the new length.  A text of
    which every line was dropped leaves the table; a text of which none was dropped stays as
    it is, also where it is null or empty or the doc_id is null.  Rows and columns are otherwise
    unchanged, repeated rows included.
    """
    repeated, remove = _repeated_lines(docs, near_words)
    gone = cut(repeated.groupBy("doc_id", "row_key").agg(F.collect_set("line_no").alias("gone")), free=True)
    remove()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("row_key"))
    lines = F.filter(F.split("row.text", "\n"), lambda _, i: ~F.array_contains("gone", i))
    joined = keyed.join(gone, ["doc_id", "row_key"], "left").withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
    row = F.col("row").withField("text", F.array_join("lines", "\n"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(F.array_join("lines", "\n")).cast(docs.schema["n_chars"].dataType))
    return (
        joined.where("lines is null or size(lines) > 0")
        .select(F.when(F.col("lines").isNotNull(), row).otherwise(F.col("row")).alias("row"))
        .select("row.*")
    )

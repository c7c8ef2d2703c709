"""Operator 3: near-duplicate documents by Order MinHash, verified by banded alignment.

The words of a text (runs of letters and digits, without case) form k-mers of 1 to 3 words, by the
length of the text (``SCHEMES``, which overlap so that two texts within the bound share one);
equal k-mers of a text are told apart by their occurrence number, so a text is a set of
labelled k-mers and repetition counts.  Each of ``SKETCHES`` hash functions picks the ``L``
smallest labelled k-mers, and the sketch is their k-mers in the order of the text (Marcais,
DeBlasio, Pandey, Kingsford, Locality-sensitive hashing for the edit distance, 2019).  Texts
that share many k-mers in another order don't collide, which is what makes the sketch
sensitive to edit similarity rather than to set similarity.

Texts with a common sketch are candidates, verified by the exact word edit distance, computed
bit-parallel inside the band that ``THRESHOLD`` permits.  A bucket of one sketch first links each
text to the smallest id and to its neighbour by length, and verified links are closed
transitively; large groups of copies need no more.  Then all members of a bucket that are still
in different groups are compared.  In a bucket of more than ``HOT`` members only those that
also share one of their rarest words are: within the bound two texts share so many words that
this loses no pair (prefix filtering).  Large groups are compared block against block, so no
task holds one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _U, BASE2, Words, _free, cut, mix, pieces, prefix_sums, signed, span_hashes, table, with_row_key, words
from .components import components

#: Words of a k-mer, and the fewest and the most words of the texts that are sketched with such.  Of pairs of
#: texts with scattered edits, at least these shares have a common sketch (tests/llm measures them):
#: all at 10 %, 0.95 at 20 %, 0.92 at 25 %; groups of more than two documents are linked more safely.
SCHEMES = ((1, 1, 8), (2, 6, 40), (3, 30, 1 << 40))
L = 2
SKETCHES = 44
THRESHOLD = 0.75
#: Members of a bucket from which on it is split by rare words, and members of a block.
HOT = 200
BLOCK = 500
#: Texts that are looked up by a broadcast of their ids, at most; the word arrays of more are shuffled.
FEW = 200_000
#: Counters of how often words are, in a power of two; words that share one have a common number.
COUNTER_BITS = 20

_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_SHORT_INV = _U(pow(int(BASE2), -1, 1 << 64))
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def occurrences(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one in its row."""
    own = values + row.astype(np.uint64) * BASE2
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    fresh = np.ones(len(own), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    runs = np.flatnonzero(fresh)
    occurrence = np.empty(len(own), dtype=np.uint64)
    occurrence[order] = (np.arange(len(own)) - np.repeat(runs, np.diff(np.append(runs, len(own))))).astype(np.uint64)
    return occurrence


def kmers(found: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each k-mer, hash of each labelled k-mer, and the first k-mer of each row, with the end.

    A row of fewer than k words, but at least one, is one shorter k-mer.
    """
    count = np.diff(found.offsets)
    number = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
    offsets = np.concatenate([[0], np.cumsum(number)])
    row = np.repeat(np.arange(len(count)), number)
    start = np.arange(len(row)) - offsets[row] + found.offsets[row]
    end = np.minimum(start + k, found.offsets[row + 1])
    kmer = span_hashes(prefix_sums(found.hash), start, end)
    return kmer, mix(kmer + occurrences(kmer, row) * BASE2), offsets


def sketches(kmer: np.ndarray, labelled: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SKETCHES hashes for each row that has a k-mer; rows must all have one."""
    size = len(labelled)
    bits = max(20, int(size).bit_length())
    low = _U((1 << bits) - 1)
    place = np.arange(size, dtype=np.uint64)
    heads = offsets[:-1]
    single = np.diff(offsets) < 2
    out = np.empty((len(heads), SKETCHES), dtype=np.uint64)
    for s in range(SKETCHES):
        value = (labelled ^ (labelled >> _U(29))) * _MULTIPLIERS[s]
        value = (value & ~low) | place
        one = np.minimum.reduceat(value, heads) & low
        value[one] = _NONE
        two = np.minimum.reduceat(value, heads) & low
        two[single] = one[single]
        a, b = kmer[np.minimum(one, two)], kmer[np.maximum(one, two)]
        out[:, s] = mix(a * _MULTIPLIERS[60] + mix(b + single.astype(np.uint64)) + _U(s))
    return out


def text_sketches(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of all rows that have a word, one after the other, and how many each row has."""
    count = np.diff(found.offsets)
    parts, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k, fewest, most in SCHEMES:
        rows = np.flatnonzero((count >= fewest) & (count <= most))
        if not len(rows):
            continue
        n = count[rows]
        offsets = np.concatenate([[0], np.cumsum(n)])
        own = found.hash[np.arange(offsets[-1]) + np.repeat(found.offsets[rows] - offsets[:-1], n)]
        kmer, labelled, heads = kmers(found._replace(hash=own, offsets=offsets), k)
        parts.append(mix(sketches(kmer, labelled, heads) + _U(k)).ravel())
        owners.append(np.repeat(rows, SKETCHES))
    owner = np.concatenate(owners)
    return np.concatenate(parts)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(count))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, piece in pieces(batch.column(2)):
            found = words(piece)
            count = np.diff(found.offsets)
            keep = np.flatnonzero(count)
            if not len(keep):
                continue
            first, last = found.offsets[keep], found.offsets[keep + 1]
            one = span_hashes(prefix_sums(found.hash), first, last)
            two = span_hashes(prefix_sums(found.hash, BASE2), first, last, _SHORT_INV)
            sketched, number = text_sketches(found)
            rows = pa.array(keep)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number[keep])]).astype(np.int32)), signed(sketched))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).take(rows), batch.column(1).slice(i, j - i).take(rows), pa.array(count[keep].astype(np.int32)), signed(one), signed(two), lists],
                names=["doc_id", "row_key", "n", "one", "two", "sketches"],
            )


def _word_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their word hashes, four bytes a word."""
    for batch in batches:
        for i, j, piece in pieces(batch.column(1)):
            found = words(piece)
            data = (found.hash >> _U(32)).astype("<u4")
            arrays = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((found.offsets * 4).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), arrays], names=["at", "words"])


def banded_distance(a: np.ndarray, b: np.ndarray, bound: int) -> int:
    """The edit distance of two sequences, or bound + 1 if it is more.

    Common ends are cut off and the multisets compared first; the rest is Hyyro's bit-parallel
    algorithm on a band of 2 * bound + 2 diagonals, one big integer a column.
    """
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    shorter = min(len(a), len(b))
    differ = np.flatnonzero(a[:shorter] != b[:shorter])
    head = int(differ[0]) if len(differ) else shorter
    a, b = a[head:], b[head:]
    shorter = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - shorter :][::-1] != b[len(b) - shorter :][::-1])
    tail = int(differ[0]) if len(differ) else shorter
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a) if len(a) <= bound else bound + 1
    values, counts = np.unique(a, return_counts=True)
    others, other_counts = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(values, others), len(values) - 1)
    common = np.minimum(counts[at], other_counts)[values[at] == others].sum()
    if len(a) - int(common) > bound:
        return bound + 1
    return _banded(a.tolist(), b.tolist(), min(bound, len(a)))


def _banded(a: list[int], b: list[int], bound: int) -> int:
    """a is at least as long as b."""
    width = 2 * bound + 2
    mask = (1 << width) - 1
    positions: dict[int, int] = {}
    n, m = len(a), len(b)
    # Positions of the words of a that lie in the band of the column, as bits; they move down one bit a column.
    window: dict[int, list[int]] = {}
    for i, w in enumerate(a):
        window.setdefault(w, []).append(i)
    for w, at in window.items():
        x = 0
        if len(at) <= 64 or n <= 4096:
            for i in at:
                x |= 1 << i
        else:
            bits = np.zeros(n, dtype=np.uint8)
            bits[at] = 1
            x = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        positions[w] = x
    shift = bound + 1 - width
    vp, vn = ((1 << (bound + 1)) - 1) << (width - bound - 1), 0
    diagonal, horizontal = 1 << (width - 1), 1 << (width - 2)
    distance = bound
    for j in range(m):
        x = positions.get(b[j], 0)
        if x:
            x = (x >> shift if shift >= 0 else x << -shift) & mask
        shift += 1
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if j < n - bound:
            distance += not d0 & diagonal
        else:
            distance += bool(hp & horizontal) - bool(hn & horizontal)
            horizontal >>= 1
        if distance > 2 * bound + m - n:
            return bound + 1
        d0 >>= 1
        vp = (hn | ~(d0 | hp)) & mask
        vn = d0 & hp
    return distance if distance <= bound else bound + 1


def allowed_edits(longer: int, threshold: float) -> int:
    return int((1 - threshold) * longer + 1e-9)


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        close = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = (np.frombuffer(v.as_buffer(), dtype="<u4") for v in (x, y))
            bound = allowed_edits(max(len(a), len(b)), threshold)
            close.append(banded_distance(a, b, bound) <= bound)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(close, pa.bool_()))


_AT = "struct<doc_id: bigint, row_key: bigint>"


def _tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Of each word array, its words, told apart by occurrence."""
    for v in batch.column(1):
        x = np.frombuffer(v.as_buffer(), dtype="<u4").astype(np.uint64)
        yield mix(x + occurrences(x, np.zeros(len(x), np.int64)) * BASE2)


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """How many words of a partition have each counter."""
    n = np.zeros(1 << bits, dtype=np.int64)
    for batch in batches:
        for tokens in _tokens(batch):
            np.add.at(n, tokens >> _U(64 - bits), 1)
    slot = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n[slot])], names=["slot", "n"])


def _rarest(arrays: DataFrame, threshold: float, bits: int = COUNTER_BITS) -> DataFrame:
    """(at, tokens): the rarest words of each text, one of which any two texts within the bound share.

    Texts of n and m words within the bound share at least threshold * max(n, m) words, so not all
    of the rarest n - threshold * n + 1 of one can be missing among those of the other.  That holds for
    any order of words that is the same for all texts; this one is by counters of a bounded number,
    so each text is looked at by itself and no word is shuffled.
    """
    found = arrays.mapInArrow(lambda batches: _counted(batches, bits), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << bits, dtype=np.int64)
    often[found["slot"].to_numpy()] = found["n"].to_numpy()
    sent = arrays.sparkSession.sparkContext.broadcast(often)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [t[np.lexsort((t, sent.value[t >> _U(64 - bits)]))[: allowed_edits(len(t), threshold) + 1]] for t in _tokens(batch)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), signed(np.concatenate([*kept, np.zeros(0, np.uint64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["at", "tokens"])

    return arrays.mapInArrow(first, f"at {_AT}, tokens array<bigint>")


def _of(arrays: DataFrame, ids: DataFrame) -> DataFrame:
    """The word arrays of the texts in the one column ``at``; those of few aren't shuffled."""
    ids = cut(ids.distinct())
    return arrays.join(F.broadcast(ids) if ids.count() <= FEW else ids, "at")


def _across(members: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(a, b) of all members (at, n, root) of a group with the same keys that have different roots, block against block."""
    group = Window.partitionBy(*keys)
    rows = (
        members.withColumn("blocks", F.ceil(F.count(F.lit(1)).over(group) / BLOCK))
        .withColumn("block", F.pmod(F.xxhash64("at"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    )
    side = lambda x: F.struct("at", "n", "root").alias(x)
    left = rows.where("block <= other").select(*keys, F.col("block").alias("i"), F.col("other").alias("j"), side("x"))
    right = rows.where("other <= block").select(*keys, F.col("other").alias("i"), F.col("block").alias("j"), side("y"))
    return (
        left.join(right, [*keys, "i", "j"])
        .where("x.root <> y.root and (i < j or x.at < y.at)")
        .where(F.abs(F.col("x.n") - F.col("y.n")) <= (1 - threshold) * F.greatest("x.n", "y.n") + 1e-9)
        .select(F.greatest("x.at", "y.at").alias("a"), F.least("x.at", "y.at").alias("b"))
        .distinct()
    )


def _verified(pairs: DataFrame, arrays: DataFrame, threshold: float) -> DataFrame:
    return (
        pairs.join(arrays.select(F.col("at").alias("a"), F.col("words").alias("x")), "a")
        .join(arrays.select(F.col("at").alias("b"), F.col("words").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(lambda batches: _verify(batches, threshold), f"a {_AT}, b {_AT}")
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that have a smaller near duplicate, with the one document of the group that stays.

    Result: doc_id, row_key, kept_doc_id, kept_row_key.  A group is a connected component of
    the pairs with a common sketch whose word edit distance is at most (1 - threshold) times the longer's number of
    words; the document with the smallest (doc_id, row_key) stays.  So a group never has a pair
    too many, but a pair near the bound may lack a common sketch; ``SCHEMES`` has the shares.  Texts of the same words
    are always in one group.

    Rows whose doc_id or text is null, and texts without a word, take no part.  Repeated rows
    (same id and text) are one document.  One id with different texts counts as different
    documents.  Other columns are ignored, whatever their names.  An empty table gives no rows.
    """
    source = with_row_key(docs, "text")
    schema = "doc_id bigint, row_key bigint, n int, one bigint, two bigint, sketches array<bigint>"
    sketched = cut(source.mapInArrow(_sketch, schema))
    distinct = cut(
        sketched.groupBy("one", "two").agg(
            F.min(F.struct("doc_id", "row_key")).alias("at"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("sketches").alias("sketches")
        )
    )
    same = (
        sketched.select("doc_id", "row_key", "one", "two")
        .join(distinct.where("copies > 1").select("one", "two", "at"), ["one", "two"])
        .select(F.struct("doc_id", "row_key").alias("a"), F.col("at").alias("b"))
        .where("a <> b")
    )
    bucket = Window.partitionBy("sketch")
    beside = Window.partitionBy("sketch").orderBy("n", "at")
    members = cut(
        distinct.select("at", "n", F.explode("sketches").alias("sketch"))
        .withColumn("size", F.count(F.lit(1)).over(bucket))
        .where("size > 1"),
        free=True,
    )
    pairs = cut(
        members.select("at", "n", F.min(F.struct("at", "n")).over(bucket).alias("first"), F.lag(F.struct("at", "n")).over(beside).alias("next"))
        .select("at", "n", F.explode(F.array("first", "next")).alias("other"))
        .where("other.at <> at")
        .where(F.abs(F.col("n") - F.col("other.n")) <= (1 - threshold) * F.greatest("n", "other.n") + 1e-9)
        .select(F.greatest("at", "other.at").alias("a"), F.least("at", "other.at").alias("b"))
        .distinct()
    )
    arrays = cut(
        members.select("at").distinct()
        .select("at.*", "at")
        .join(source, ["doc_id", "row_key"])
        .dropDuplicates(["doc_id", "row_key"])
        .select("at", "text")
        .mapInArrow(_word_arrays, f"at {_AT}, words binary"),
        free=True,
    )
    found = components(same.unionByName(_verified(pairs, arrays, threshold)))
    _free(docs.sparkSession)
    # what the links left in different groups
    grouped = members.where("size > 2").join(found.select(F.col("node").alias("at"), "root"), "at", "left").withColumn("root", F.coalesce("root", "at"))
    mixed = cut(grouped.withColumn("low", F.min("root").over(bucket)).withColumn("high", F.max("root").over(bucket)).where("low <> high").select("at", "n", "root", "sketch", "size"))
    rest = _across(mixed.where(F.col("size") <= HOT), ["sketch"], threshold)
    hot = mixed.where(F.col("size") > HOT)
    drop = lambda: None
    if not hot.isEmpty():
        rare = _rarest(_of(arrays, hot.select("at")).select("at", "words"), threshold)
        # equal hashes of different keys only add pairs to verify
        split, drop = table(hot.join(rare, "at").select("at", "n", "root", "sketch", F.explode("tokens").alias("token")).select("at", "n", "root", F.xxhash64("sketch", "token").alias("key")))
        rest = rest.unionByName(_across(split, ["key"], threshold)).distinct()
        del split
    rest = cut(rest.join(pairs, ["a", "b"], "left_anti"), free=True)
    drop()
    if not rest.isEmpty():
        links = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        arrays = _of(arrays, rest.select(F.col("a").alias("at")).union(rest.select("b")))
        found = components(links.unionByName(_verified(rest, arrays, threshold)))
    return found.where("node <> root").select("node.*", F.col("root.doc_id").alias("kept_doc_id"), F.col("root.row_key").alias("kept_row_key"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near duplicates.

    Rows that take no part (a null id or text, no words) stay.  Of a document that stays all
    repeated rows stay; of one that goes all go.  Columns are unchanged, whatever their names.
    """
    gone = near_duplicates(docs, threshold).select("doc_id", "row_key")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("row_key"))
    return keyed.join(gone, ["doc_id", "row_key"], "left_anti").select("row.*")

"""What the operators share: checkpoints, row identity and vectorised text kernels.

The kernels work on the UTF-8 buffers of Arrow string arrays with numpy, so no Python
object is made per word.  They always take whole texts: an Arrow batch is cut between
rows only, so one very long text is one piece.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BASE2 = _U(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    A temporary one is set only where that setting is missing and Spark runs in one process, as
    in tests; on a cluster the executors wouldn't share it, so the setting is asked for.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("A cluster needs spark.checkpoint.dir, a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="probitas-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint, which outlives the executors.

    With ``free``, the shuffle files behind it are removed, too; they are of no use any more.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint()
    del df
    if free:
        _free(spark)
    return out


def table(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Cut the lineage of ``df`` with a Parquet table in the checkpoint folder.

    It takes a third of a checkpoint's space, and only the columns asked for are read.  The
    function returned removes it; what is never removed goes when the session ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = f"{checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(folder)
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    del df
    _free(spark)
    return spark.read.parquet(folder), lambda: files.delete(path, True)


def _free(spark: SparkSession) -> None:
    """Have shuffle files removed that nothing refers to any more.

    Spark removes them when their owners are found to be garbage, on the driver's Python side and
    then in its JVM; both are asked to look now, which takes half a second.
    """
    gc.collect()
    for _ in range(2):  # what Python lets go of is garbage only at the second time
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_row_key(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns asked for, with ``doc_id`` and ``row_key``, of the rows that have an id and a text.

    ``row_key`` is a hash of the text, so two rows that share an id but not a text stay apart,
    and repeated rows get one identity.
    """
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("row_key"), *columns
    )


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def prefix_sums(values: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[t] * base**t for i <= t < j."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.uint64 = BASE_INV) -> np.ndarray:
    """Hashes of the spans [start, end) that don't depend on where a span lies."""
    return mix((sums[end] - sums[start]) * powers(inverse, len(sums))[start] + (end - start).astype(np.uint64) * BASE2)


class Pieces(NamedTuple):
    """Text rows as bytes. data: the bytes as they are; offsets: where each row begins, and the end."""

    data: np.ndarray
    offsets: np.ndarray


def pieces(array: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, Pieces]]:
    """(first row, row after the last, bytes) for runs of rows with ``limit`` bytes or a single row."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(array):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, Pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True
_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters; other letters stay as they are."""
    low = _LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = data[after]
    low[after[(upper >= 0x80) & (upper <= 0x9E) & (upper != 0x97)]] |= 0x20
    return low


def word_bytes(data: np.ndarray) -> np.ndarray:
    """True for the bytes of letters and digits; general punctuation and Latin-1 signs beyond ASCII are False."""
    inside = _ALNUM[data]
    if len(data) > 1:
        sign = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81)))
        for step in range(3):
            inside[sign + step] = False
        sign = np.flatnonzero(data[:-1] == 0xC2)
        inside[sign] = inside[sign + 1] = False
    return inside


def solid_bytes(data: np.ndarray) -> np.ndarray:
    """True for the bytes that aren't ASCII white space."""
    return _SOLID[data]


def byte_values(low: np.ndarray) -> np.ndarray:
    """A random number for each byte, to be summed up to hashes."""
    return _BYTE[low]


class Words(NamedTuple):
    """hash, start and end byte of each word; offsets: the first word of each row, and the end."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray


def runs(piece: Pieces, inside: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of maximal runs of ``inside`` bytes; they don't cross rows or breaks."""
    n = len(piece.data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[piece.offsets] = True
    if breaks is not None:
        edge[breaks] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    behind = np.zeros(n, dtype=bool)
    behind[:-1] = inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~behind | edge[1:])) + 1


def words(piece: Pieces, inside: np.ndarray | None = None, low: np.ndarray | None = None, breaks: np.ndarray | None = None) -> Words:
    """Maximal runs of ``inside`` bytes, hashed without case; runs don't cross rows."""
    data, offsets = piece
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64))
    inside = word_bytes(data) if inside is None else inside
    low = lowered(data) if low is None else low
    start, end = runs(piece, inside, breaks)
    hashes = span_hashes(prefix_sums(byte_values(low)), start, end)
    return Words(hashes, start, end, np.searchsorted(start, offsets))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))

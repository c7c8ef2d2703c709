"""Operator 10: mixing sources to target weights by Sainte-Lague apportionment.

Documents are spread over shards by a hash of their id.  Within a shard, the documents of a
source, in a seeded order, are one stream of tokens, cut into blocks of exactly ``block``
tokens; what is left at the end of a stream is no block.  ``share`` of the blocks of a shard,
rounded down, are seats: seat after seat goes to the source with the highest quotient
weight / (2 * seats so far + 1) that still has a block, which is the Sainte-Lague method.  The
quotas are integers, fixed before any block is picked; then each source's blocks are picked in
another seeded order.  The result holds the text of the blocks, so a corpus can be written from it
alone.

``share`` is the size of the mixture: with 1.0 every block is taken, whatever the weights.  The weights
are reached as long as no source runs out of blocks; then its seats go to the others.

The number of shards follows the number of tokens, so a shard, and each window over one, has
about ``shard_tokens`` tokens at any size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pieces, runs

BLOCK = 1024
SHARD_TOKENS = 16_000_000
SHARE = 0.5
SEED = 17
TOKEN = "[^ \\t\\n\\r\\f]+"
_TOKEN = np.ones(256, dtype=bool)
_TOKEN[[9, 10, 12, 13, 32]] = False


def _span_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text with the list of its spans to a row for each span, with the bytes of the span."""
    for batch in batches:
        for i, j, piece in pieces(batch.column(3)):
            start, end = runs(piece, _TOKEN[piece.data])
            edges = np.searchsorted(start, piece.offsets)
            parts = batch.column(4).slice(i, j - i)
            row = np.repeat(np.arange(j - i), parts.value_lengths().to_numpy())
            block, first, last = (parts.flatten().field(k) for k in range(3))
            a, b = first.to_numpy(), last.to_numpy()
            # white space belongs to the token behind it, at the end of the text to the last token
            begin = np.where(a > 0, end[edges[row] + np.maximum(a, 1) - 1], piece.offsets[row])
            stop = np.where(edges[row] + b < edges[row + 1], end[edges[row] + b - 1], piece.offsets[row + 1])
            data = piece.data.tobytes()
            texts = pa.array([data[x:y] for x, y in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary()).cast(pa.string())
            keys = [batch.column(k).slice(i, j - i).take(pa.array(row)) for k in range(3)]
            shard = batch.column(5).slice(i, j - i).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [shard, keys[2], block, keys[0], keys[1], first, last, texts], names=["shard", "source", "block", "doc_id", "row_key", "first_token", "end_token", "text"]
            )


def mixture(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    share: float = SHARE,
    block: int = BLOCK,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """The blocks picked, as the spans of documents that make them up.

    weights: target weight by source; a source without one gets no block.  None: all sources
    weigh the same.  Result: shard, source, block (number in the stream), doc_id, row_key (MD5 of
    the document's text), first_token, end_token (the span within the document, end exclusive),
    text (of the span, with the white space before each token; the last span of a document also has
    the white space at its end, so all spans of a document joined are its text).  The spans of
    a block add up to ``block`` tokens; in the order of the stream they follow each other.  Tokens
    are runs without white space.

    Rows whose doc_id or text is null, and texts without a token, take no part.  A null source
    is a source of its own, with weight 1 if weights is None, else 0.  Documents with one id are
    told apart by row_key, also in the order of the stream.  Repeated rows are as many
    parts of the stream.  Ties of quotients go to the smaller source name, null last.  Other
    columns are ignored, whatever their names.  An empty table gives no rows.
    """
    source = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.md5(F.col("text").cast("binary")).alias("row_key"), "source", "text")
    counted = cut(source.select("doc_id", "row_key", "source", F.regexp_count("text", F.lit(TOKEN)).cast("bigint").alias("tokens")).where("tokens > 0"))
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id")).cast("binary"))
    stream = Window.partitionBy("shard", "source").orderBy("order", "doc_id", "tokens", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        counted.withColumn("order", order)
        .withColumn("shard", (F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint") % shards).cast("int"))
        .withColumn("end", F.sum("tokens").over(stream))
        .withColumn("start", F.col("end") - F.col("tokens"))
    )
    streams = placed.groupBy("shard", "source").agg(F.floor(F.sum("tokens") / block).cast("bigint").alias("blocks")).where("blocks > 0")
    if weights is None:
        weight = F.lit(1.0)
    else:
        table = [F.lit(x) for name, w in weights.items() for x in (name, float(w))]
        weight = F.coalesce(F.create_map(*table)[F.col("source")], F.lit(0.0)) if table else F.lit(0.0)
    ranked = Window.partitionBy("shard").orderBy(F.col("quotient").desc(), F.col("source").asc_nulls_last(), "seat")
    seats = (
        streams.withColumn("all", F.sum("blocks").over(Window.partitionBy("shard")))
        .withColumn("weight", weight)
        .where("weight > 0")
        .select("shard", "source", "all", "weight", F.explode(F.sequence(F.lit(1).cast("bigint"), "blocks")).alias("seat"))
        .withColumn("quotient", F.col("weight") / (2 * F.col("seat") - 1))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= F.floor(F.col("all") * F.lit(share)))
    )
    quotas = seats.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("quota"))
    label = F.coalesce("source", F.lit(""))
    pick = F.md5(F.concat_ws(":", F.lit(seed), F.col("shard"), F.col("block"), label).cast("binary"))
    chosen = (
        streams.select("shard", "source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
        .withColumn("pick", F.row_number().over(Window.partitionBy("shard", "source").orderBy(pick, "block")))
        # the quotas grow with the number of shards, so they are never sent to every executor
        .join(quotas.withColumnsRenamed({"shard": "q_shard", "source": "q_source"}).hint("merge"), F.col("shard").eqNullSafe(F.col("q_shard")) & F.col("source").eqNullSafe(F.col("q_source")))
        .where("pick <= quota")
        .select(F.col("shard").alias("c_shard"), F.col("source").alias("c_source"), F.col("block").alias("c_block"))
    )
    spans = placed.select(
        "shard",
        "source",
        "doc_id",
        "row_key",
        "start",
        "end",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block"),
    )
    low, high = F.col("block") * block, (F.col("block") + 1) * block
    part = F.struct("block", (F.greatest("start", low) - F.col("start")).alias("first_token"), (F.least("end", high) - F.col("start")).alias("end_token"))
    # one list for each part of a stream, as long as a document has blocks
    parts = (
        spans.join(
            chosen,
            (F.col("shard") == F.col("c_shard")) & F.col("source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block")),
        )
        .groupBy("shard", "source", "doc_id", "row_key", "start")
        .agg(F.collect_list(part).alias("parts"))
    )
    texts = source.select("doc_id", "row_key", "text").dropDuplicates(["doc_id", "row_key"])
    return (
        parts.join(texts, ["doc_id", "row_key"])
        .select("doc_id", "row_key", "source", "text", "parts", "shard")
        .mapInArrow(_span_texts, "shard int, source string, block bigint, doc_id bigint, row_key string, first_token bigint, end_token bigint, text string")
    )

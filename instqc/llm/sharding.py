"""Sharding along a Hilbert curve over document metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from instqc.llm.common import attach, carried, size_class, with_position

SHARDS = 8
#: Bits per dimension of the curve.
BITS = 5


def hilbert_index(levels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits per dimension.

    ``levels`` is (points, dimensions). From the high bit down, each dimension
    either flips the lower bits of the first dimension or swaps them with its
    own, which turns the current cell so that the curve enters and leaves it
    next to its neighbours; a Gray code over the interleaved bits follows.
    """
    x = levels.T.astype(np.uint64).copy()
    n = len(x)
    top = np.uint64(1) << np.uint64(bits - 1)
    q = top
    while q > 1:
        low = q - np.uint64(1)
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.uint64)
    q = top
    while q > 1:
        flips ^= np.where((x[n - 1] & q) != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= flips
    out = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def curve_place(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in parts:
        yield pd.Series(hilbert_index(np.stack([c.to_numpy(np.int64) for c in columns], axis=1)))


def equal_depth(df: DataFrame, column: str, n_rows: int, bits: int = BITS) -> DataFrame:
    """Level of each value of a column: values in order, cut where the rows before them pass a 2**bits-th.

    One row per value (sources, languages or size classes), so the window
    spans few rows.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return counts.select(column, F.floor(start * (1 << bits) / F.lit(max(n_rows, 1))).cast("int").alias(f"{column}_level"))


#: Within a cell of the grid, texts are dealt to so many buckets by their digest, one after another.
TEXT_BUCKETS = 64


def measures(docs: DataFrame) -> list[Column]:
    """What places a row: doc_id, _source, _lang, _size, _class, and _bucket, the same for equal texts."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    return [
        F.col("doc_id"), named("source").alias("_source"), named("lang").alias("_lang"), size.alias("_size"), size_class(size).alias("_class"),
        F.pmod(F.xxhash64(text), F.lit(TEXT_BUCKETS)).cast("int").alias("_bucket"),
    ]


def placed(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows of ``measures`` in runs of the curve: adds _place, shard and slot.

    The dimensions are source, language and size class, each quantised to
    equal depth. Shards are runs of the curve with counts at most one apart,
    so each file holds few sources, languages and sizes and their ranges prune
    reads. Within a cell of the grid the order is by a bucket of the text, then
    by the hash of the id: equal texts of one source and language stand in one
    bucket of one cell and so in one shard, unless a cut between shards falls
    into that bucket. Equal texts of different source or language lie in
    different cells and may be apart. Null source or language counts as a
    value of its own, null text has size 1. Rows alike in id and place are
    interchangeable. No table, no rows.
    """
    n_rows = rows.count()
    for column in ("_source", "_lang", "_class"):
        rows = attach(rows, equal_depth(rows, column, n_rows), [column], ["doc_id", "_size"])
    rows = rows.withColumn("_place", curve_place("_source_level", "_lang_level", "_class_level"))
    rows = with_position(rows, [], ["_place", "_bucket"], ["doc_id", "_size"], n_rows)
    whole, rest = divmod(n_rows, shards)
    # The first `rest` shards hold one row more.
    long_part = rest * (whole + 1)
    position = F.col("_position")
    number = F.when(position < long_part, F.floor(position / F.lit(whole + 1))).otherwise(rest + F.floor((position - long_part) / F.lit(max(whole, 1))))
    start = F.when(position < long_part, F.col("shard") * (whole + 1)).otherwise(long_part + (F.col("shard") - rest) * whole)
    return rows.withColumn("shard", number.cast("int")).withColumn("slot", (position - start).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with shard and slot, see ``placed``.

    Columns come through as they are, but for given ones of these two names,
    which the new ones replace.
    """
    own = docs.drop("shard", "slot")
    return placed(own.select(carried(own), *measures(own)), shards).select("_row.*", "shard", "slot")


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) and curve_index of every document."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_crc")
    return placed(docs.select(crc, *measures(docs)), shards).select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("_place").alias("curve_index"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write one folder per shard, rows in the order of the curve."""
    cut = shard(docs, shards)
    cut.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

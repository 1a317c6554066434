"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from instqc.functions.skew import salted_join
from instqc.session import cut_lineage

#: A table is broadcast by hint only if a count has shown that its rows are few.
BROADCAST_ROWS = 200_000

#: Bits, as a power of two, by which more keys than that are sought before they are joined: 8 MB, whatever the number of keys.
SOUGHT_BITS = 26

#: Most bytes of an Arrow batch on its way to a Python worker.
ARROW_BYTES = 4 << 20

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers by bytes, as ten thousand texts may be any size.

    A session whose own bound is lower keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def digest(text: Column) -> Column:
    """128 bits that stand for a text, null as empty; unlike 64 they tell apart as many texts as there are."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def carried(docs: DataFrame) -> Column:
    """All columns of a row in one, ``_row``, so that they meet no name used on the way."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def attach(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a large table with one row per key.

    ``small`` is written and counted; it is broadcast up to BROADCAST_ROWS rows
    and joined over salted keys beyond, so that a hot key is spread either way.
    """
    small = cut_lineage(small)
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), list(on), how)
    return salted_join(big, small, on, spread, how)


def bounded(small: DataFrame) -> DataFrame:
    """A written table, hinted to be broadcast if a count shows that its rows are few, and else to be joined by shuffle.

    Without a hint Spark goes by the size of its files. Rows may be far larger
    in memory, and Spark does not count those that a generator adds to them.
    """
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("merge")


def only_keys(big: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``big`` whose key is in ``keys``; broadcast up to BROADCAST_ROWS keys.

    More keys are joined by shuffle. Of ``big`` only rows whose hash is that
    of some key take part: hashes are marked in bits of a fixed number.
    """
    keys = cut_lineage(keys.select(*on).distinct())
    if keys.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(keys), list(on), "left_semi")
    # Keys are distinct, so this is the semi-join, which Spark would do before the bits are looked at.
    return maybe_in(big, keys, on).join(keys.hint("merge"), list(on)).select(*big.columns)


def maybe_in(big: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``big`` whose key may be in ``keys``: all that are, and of the others as many as the share of bits set."""
    mark = F.xxhash64(*(F.col(c) for c in on)).bitwiseAND(F.lit((1 << SOUGHT_BITS) - 1))
    bits = keys.select(mark.alias("_mark")).groupBy(F.shiftright("_mark", 15).alias("_block")).agg(
        F.bitmap_construct_agg(F.col("_mark").bitwiseAND(F.lit(32767))).alias("_bits"))
    met = big.withColumn("_mark", mark).withColumn("_block", F.shiftright("_mark", 15)).join(F.broadcast(bits), "_block")
    byte = F.conv(F.hex(F.substring("_bits", F.expr("CAST(shiftright(_mark & 32767, 3) AS INT) + 1"), F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, F.col("_mark").bitwiseAND(F.lit(7)).cast("int")) == 1).select(*big.columns)


def size_class(size: Column) -> Column:
    """Number of digits and the two leading digits: steps of one to ten per cent."""
    digits = size.cast("string")
    return (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).cast("int")


def with_position(df: DataFrame, group: Sequence[str], cell: Sequence[str], tie: Sequence[str], n_rows: int) -> DataFrame:
    """Rows with their position from 0 in each group.

    The order in a group is by ``cell``, then by the MD5 of the first ``tie``
    column, then by all ``tie`` columns. Cells are cut by that hash into about
    sqrt(n_rows) parts; parts are counted with map-side sums, a window over
    the parts of a cell and one over the cells of a group give each part its
    offset, and rows are numbered inside their part. No window spans a whole
    group, and neither the rows of a part nor the parts of a cell are more
    than about sqrt(n_rows), also when one group or cell holds most rows.
    Group and cell columns must not be null. Rows equal in all these columns
    may swap places.
    """
    parts = max(1, int(n_rows**0.5))
    group, cell = list(group), list(cell)
    hashed = df.withColumn("_hash", F.md5(F.coalesce(F.col(tie[0]).cast("string"), F.lit("")))).withColumn(
        "_part", F.shiftright(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * parts, 32)
    )
    keys = [*group, *cell, "_part"]
    counts = cut_lineage(hashed.groupBy(*keys).agg(F.count("*").alias("_n")))
    before = lambda over, order: Window.partitionBy(*over).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    in_cell = counts.groupBy(*group, *cell).agg(F.sum("_n").alias("_n"))
    in_cell = in_cell.withColumn("_cell_start", F.coalesce(F.sum("_n").over(before(group or [F.lit(0)], cell)), F.lit(0))).drop("_n")
    starts = counts.withColumn("_part_start", F.coalesce(F.sum("_n").over(before([*group, *cell], ["_part"])), F.lit(0))).drop("_n")
    starts = starts.join(in_cell, [*group, *cell]).select(*keys, (F.col("_cell_start") + F.col("_part_start")).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy("_hash", *tie)
    placed = hashed.join(starts, keys).withColumn("_position", F.col("_start") + F.row_number().over(inside) - 1)
    return placed.drop("_hash", "_part", "_start")

"""Exact order statistics over groups of any size.

The built-in exact percentile keeps a whole group in one task. Here a group is
first reduced to counted distinct values, and groups with many distinct values
are cut into value buckets, so no task ever sees more than one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from instqc.functions.skew import salted_join
from instqc.session import cut_lineage

BUCKETS = 256
GROUP_LIMIT = 1_000_000


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, cnt): distinct values of a group with their frequency.

    Written once, because ranking reads it several times and what lies below
    (often a join of whole voxel tables) must not run again.
    """
    counts = df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    return cut_lineage(counts)


def group_totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: n, n_missing (observations without a value), n_values, lo, hi, mean."""
    return counts.groupBy(*keys).agg(*[F.expr(e) for e in (
        "coalesce(sum(IF(value IS NULL, 0, cnt)), 0) AS n",
        "coalesce(sum(IF(value IS NULL, cnt, 0)), 0) AS n_missing",
        "count(value) AS n_values",
        "min(value) AS lo",
        "max(value) AS hi",
        "try_divide(sum(value * cnt), sum(IF(value IS NULL, 0, cnt))) AS mean",
    )])


def cumulative(counts: DataFrame, keys: Sequence[str], group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The non-NULL values with ``below`` (how many observations of their group
    are smaller) and the group's ``n``, ``lo``, ``hi`` and ``mean``.

    Whether any group has more distinct values than ``group_limit`` is looked
    up first. Usually none has, and one shuffle by group serves the ranking and
    whatever is aggregated by group afterwards.
    """
    keys = list(keys)
    values = counts.filter("value IS NOT NULL")
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
    if sizes.filter(F.col("n_values") > group_limit).limit(1).collect():
        return _cumulative_in_buckets(counts, keys, group_limit)
    by = ", ".join(keys)
    group, before = f"(PARTITION BY {by})", f"(PARTITION BY {by} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return values.selectExpr(
        *keys, "value", "cnt", f"coalesce(sum(cnt) OVER {before}, 0) AS below",
        f"sum(cnt) OVER {group} AS n", f"min(value) OVER {group} AS lo", f"max(value) OVER {group} AS hi",
        f"sum(value * cnt) OVER {group} / sum(cnt) OVER {group} AS mean",
    )


def _cumulative_in_buckets(counts: DataFrame, keys: list[str], group_limit: int) -> DataFrame:
    """The same for groups that do not fit one task.

    Large groups are cut at approximate quantiles of their distinct values.
    The cut points balance the buckets and do not affect the result.
    """
    totals = group_totals(counts, keys)
    values = counts.filter("value IS NOT NULL")
    large = totals.filter(F.col("n_values") > group_limit).select(*keys)
    at = ", ".join(f"{i / BUCKETS!r}D" for i in range(1, BUCKETS))
    cuts = (
        values.join(large, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.expr(f"percentile_approx(value, array({at}), 10000) AS _cuts"))
    )
    shape = totals.join(cuts, keys, "left")
    rows = salted_join(values, shape.drop("n_missing", "n_values"), keys, ["value"])
    rows = rows.withColumn("_bucket", F.expr("IF(_cuts IS NULL, 0, size(filter(_cuts, c -> c < value)))"))

    before = Window.partitionBy(*keys, "_bucket").orderBy("value").rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        rows.filter(F.col("_cuts").isNotNull())
        .groupBy(*keys, "_bucket")
        .agg(F.sum("cnt").alias("_in"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_offset"))
    )
    ranked = rows.withColumn("_before", F.coalesce(F.sum("cnt").over(before), F.lit(0)))
    return (
        ranked.join(offsets, [*keys, "_bucket"], "left")
        .withColumn("below", F.col("_before") + F.coalesce("_offset", F.lit(0)))
        .select(*keys, "value", "cnt", "below", "n", "lo", "hi", "mean")
    )


def _position(q: float) -> str:
    return f"({float(q)!r}D * (n - 1))"


def order_statistics(fractions: Sequence[float]) -> list[Column]:
    """Aggregates picking the two neighbours of every fraction's position."""
    return [
        F.expr(f"max(CASE WHEN below <= {at}({_position(q)}) AND {at}({_position(q)}) < below + cnt THEN value END) AS _{side}{i}")
        for i, q in enumerate(fractions)
        for side, at in (("a", "floor"), ("b", "ceil"))
    ]


def interpolated(fractions: Sequence[float]) -> list[str]:
    """SQL of the linear interpolation between the picked neighbours (needs ``n``)."""
    return [
        f"(_a{i} + (_b{i} - _a{i}) * ({_position(q)} - floor({_position(q)})))" for i, q in enumerate(fractions)
    ]


def average_rank() -> Column:
    """Rank with ties averaged, from ``below`` and ``cnt``."""
    return F.col("below") + (F.col("cnt") + 1) / F.lit(2.0)

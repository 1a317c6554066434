"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(
    big: DataFrame,
    per_key: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = 64,
) -> DataFrame:
    """Join many rows per key with one small row per key.

    ``big`` is spread over ``salts`` sub-keys by a hash of the ``spread``
    columns and ``per_key`` is repeated once per sub-key, so a key holding a
    third of ``big`` is worked on by ``salts`` tasks, which adaptive skew
    handling may split further. Adaptive execution may also turn the join into
    a broadcast when ``per_key`` proves small. The sub-keys come from a join, as
    Spark's estimate of the size, by which it chooses a broadcast beforehand,
    counts the rows that a join makes but not those of a generator.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = per_key.crossJoin(F.broadcast(per_key.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("_salt"))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def hub_join(
    edges: DataFrame,
    per_node: DataFrame,
    on: Sequence[str],
    degree: str,
    hub_degree: int,
) -> DataFrame:
    """Inner join of an edge table with one row per node.

    Nodes with more than ``hub_degree`` edges are joined by broadcast: with E
    edges there are at most ``2 * E / hub_degree`` of them, so the caller
    bounds the broadcast by the choice of ``hub_degree``. All other nodes are
    joined by shuffle, without the hubs' edges.
    """
    hubs = F.broadcast(per_node.filter(F.col(degree) > hub_degree))
    rest = per_node.filter(F.col(degree) <= hub_degree)
    light = edges.join(hubs.select(*on), list(on), "left_anti").join(rest, list(on))
    return light.unionByName(edges.join(hubs, list(on)))


#: Keys that are broadcast to filter a large table, after counting them.
BROADCAST_KEYS = 200_000


def of_cases(big: DataFrame, cases: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of a large table whose case is (``left_anti``: is not) among ``cases``.

    The case ids are counted first. Few are broadcast, so the large table is
    not shuffled; many are joined by shuffle, where adaptive execution splits
    a large case. ``cases`` should be a written table, as it is read twice.
    """
    keys = cases.select("case_id").distinct()
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return big.join(keys, "case_id", how)


def case_join(big: DataFrame, per_case: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Inner join of a large table with one small row per case: few are broadcast after a count, many salted."""
    if per_case.count() <= BROADCAST_KEYS:
        return big.join(F.broadcast(per_case), "case_id")
    return salted_join(big, per_case, ["case_id"], spread)

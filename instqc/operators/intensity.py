"""First-order intensity statistics under each label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instqc.functions.quantiles import cumulative, group_totals, interpolated, order_statistics, value_counts
from instqc.functions.skew import BROADCAST_KEYS
from instqc.session import cut_lineage

KEYS = ["case_id", "label"]
AXES = ["x", "y", "z"]
#: Edge of a tile, as a power of two.
TILE_BITS = 3
BINS = 32
FRACTIONS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
STATISTICS = (
    "mean", "median", "std", "min", "max", "p05", "p25", "p50", "p75", "p95",
    "range", "iqr", "entropy",
)


def near_labels(voxels: DataFrame, scans: DataFrame) -> DataFrame:
    """The scan rows that lie in a tile with a labelled voxel.

    Labels fill a small part of a scan. The tiles they touch are counted; few
    are broadcast, so that all other rows of the scan are dropped where they
    are read, before any shuffle; many filter by a shuffle of (case, tile).
    """
    tile = ["case_id", *[f"_t{a}" for a in AXES]]
    tiled = lambda df: df.select("*", *[F.shiftright(a, TILE_BITS).alias(f"_t{a}") for a in AXES])
    touched = cut_lineage(tiled(voxels.select("case_id", *AXES)).select(*tile).distinct())
    if touched.count() <= BROADCAST_KEYS:
        touched = F.broadcast(touched)
    return tiled(scans).join(touched, tile, "left_semi").select(*scans.columns)


def sampled(voxels: DataFrame, scans: DataFrame) -> DataFrame:
    """Intensity of every labelled voxel; non-finite samples become NULL."""
    scans = near_labels(voxels, scans)
    joined = voxels.select("case_id", *AXES, "label").join(scans, ["case_id", *AXES])
    finite = ~F.isnan("hu") & (F.abs("hu") < float("inf"))
    return joined.select(*KEYS, F.when(finite, F.col("hu")).alias("hu"))


def label_intensity(voxels: DataFrame, scans: DataFrame) -> DataFrame:
    """Fifteen statistics per (case, label); all NULL without a finite sample.

    The voxel join is reduced at once to counted distinct values; moments,
    percentiles and the entropy histogram come from these in one aggregation.
    """
    counts = value_counts(sampled(voxels, scans), KEYS, "hu")
    rows = cumulative(counts, KEYS)
    bin_of = f"IF(hi = lo, 0, least({BINS - 1}, floor((value - lo) / (hi - lo) * {BINS})))"
    fractions = list(FRACTIONS.values())
    stats = rows.withColumn("_bin", F.expr(bin_of)).groupBy(*KEYS, "n").agg(
        F.expr("sum(cnt * (value - mean) * (value - mean)) AS _ss"),
        *order_statistics(fractions),
        *[F.expr(f"sum(IF(_bin = {i}, cnt, 0)) AS _h{i}") for i in range(BINS)],
    )
    shares = ", ".join(f"_h{i} / n" for i in range(BINS))
    stats = stats.selectExpr(
        *KEYS,
        "sqrt(_ss / n) AS std",
        *[f"{text} AS {name}" for name, text in zip(FRACTIONS, interpolated(fractions))],
        f"aggregate(array({shares}), 0D, (t, p) -> IF(p > 0, t - p * log2(p), t)) AS entropy",
    )
    df = group_totals(counts, KEYS).join(stats, KEYS, "left")
    return df.selectExpr(
        *KEYS,
        "n AS voxel_count",
        "n_missing AS n_nonfinite_excluded",
        "mean",
        "p50 AS median",
        "std",
        "lo AS min",
        "hi AS max",
        *FRACTIONS,
        "hi - lo AS range",
        "p75 - p25 AS iqr",
        "entropy",
    )

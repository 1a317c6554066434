"""Input tables of the engine, derived from the star-schema test tables.

Each text runs in Spark and, with its placeholders resolved, in DuckDB. A case
is a block of ten suppliers, so the number of cases grows with the data; every
line item becomes a voxel of its case.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from instqc.session import cut_lineage

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # One row per line item, placed in its case's grid.
    "v_cells": """
        SELECT concat('c', cn) AS case_id, cn, x, y, z, band,
               CAST(CASE WHEN cn % 5 = 1 AND band = 1 THEN 22
                         WHEN cn % 5 = 1 AND band = 2 THEN 21
                         WHEN cn % 5 = 2 AND band = 2 THEN 0
                         WHEN cn % 5 = 3 AND band = 4 THEN 28
                         WHEN cn % 5 = 4 AND band = 0 THEN 40
                         ELSE 20 + band END AS INT) AS label,
               price, quantity, line
        FROM (
          SELECT cn, x, y, z, CAST(floor(z / 8) AS INT) AS band, price, quantity, line
          FROM (
            SELECT CAST(floor(l_suppkey / 10) AS INT) AS cn,
                   CAST(CASE WHEN floor(l_suppkey / 10) % 2 = 0 THEN 1 + l_partkey % 14 ELSE l_partkey % 16 END AS INT) AS x,
                   CAST(CASE WHEN floor(l_suppkey / 10) % 2 = 0 THEN 1 + l_orderkey % 14 ELSE l_orderkey % 16 END AS INT) AS y,
                   CAST((l_orderkey + l_partkey + l_linenumber) % 40 AS INT) AS z,
                   l_extendedprice AS price, l_quantity AS quantity, l_linenumber AS line
            FROM {lineitem}
          ) a
        ) b""",
    "v_voxels": """
        SELECT DISTINCT case_id, cn, x, y, z, label FROM {v_cells} WHERE label <> 0""",
    # Per case a grid; every third case also has an empty sibling without voxels.
    "v_cases": """SELECT DISTINCT cn FROM {v_cells}""",
    "v_grid_rows": """
        SELECT concat('c', cn) AS case_id, cn FROM {v_cases}
        UNION ALL
        SELECT concat('e', cn) AS case_id, cn FROM {v_cases} WHERE cn % 3 = 0""",
    "v_grids": """
        SELECT case_id, cn, 16 AS nx, 16 AS ny, 40 AS nz,
               1 + CAST(cn % 4 AS DOUBLE) / 2 AS sx, 1 + CAST(cn % 4 AS DOUBLE) / 2 AS sy,
               CAST(1.25 AS DOUBLE) + CAST(cn % 3 AS DOUBLE) / 4 AS sz,
               CASE cn % 4 WHEN 0 THEN 'RAS' WHEN 1 THEN 'LPS' WHEN 2 THEN 'RAI' ELSE 'PIR' END AS axcodes
        FROM {v_grid_rows}""",
    # The scan's grid: shape or affine is off for some cases.
    "v_scan_grids": """
        SELECT case_id, cn, CASE WHEN cn % 7 = 6 THEN 17 ELSE 16 END AS nx, 16 AS ny, 40 AS nz,
               1 + CAST(cn % 4 AS DOUBLE) / 2 + CASE WHEN cn % 5 = 4 THEN CAST(0.001 AS DOUBLE) ELSE CAST(0.00001 AS DOUBLE) END AS sx,
               1 + CAST(cn % 4 AS DOUBLE) / 2 AS sy,
               CAST(1.25 AS DOUBLE) + CAST(cn % 3 AS DOUBLE) / 4 AS sz
        FROM {v_grid_rows}""",
    # One intensity per voxel, some of them not a number.
    "v_scan": """
        SELECT case_id, x, y, z,
               CASE WHEN min(line) = 7 THEN CAST('NaN' AS DOUBLE)
                    ELSE min(price) / 50 - 130 * (min(cn) % 7) END AS hu
        FROM {v_cells} GROUP BY case_id, x, y, z""",
    # Candidate map: voxels moved, a level partly renamed, a level lost, some maps empty.
    "v_cand": """
        SELECT case_id, min(cn) AS cn, x, y, z, min(label) AS label
        FROM (
          SELECT case_id, cn, x, y,
                 CAST(CASE WHEN (x + y + z) % 7 = 0 THEN (z + 1) % 40 ELSE z END AS INT) AS z,
                 CAST(CASE WHEN label = 22 AND x % 5 = 0 THEN 23 ELSE label END AS INT) AS label
          FROM {v_voxels} WHERE NOT (label = 20 AND cn % 4 = 1) AND cn % 11 <> 5
        ) m GROUP BY case_id, x, y, z""",
    # Several labels at one position.
    "v_multi": """
        SELECT case_id, cn, x, y, z, label FROM {v_voxels}
        UNION ALL
        SELECT case_id, cn, x, y, z, CAST(label + 1 AS INT) AS label FROM {v_voxels} WHERE z % 8 = 7 AND label < 24""",
    "v_expected": """
        SELECT case_id, cn,
               CASE WHEN cn % 3 = 0 THEN 'flagged-for-review' ELSE 'pass' END AS expected_verdict,
               CASE WHEN cn % 3 = 0 THEN CAST(cn % 8 + 1 AS INT) END AS failure_mode,
               CASE WHEN cn % 3 <> 0 THEN NULL
                    WHEN cn % 8 IN (0, 3) THEN 'mislabel' WHEN cn % 8 IN (1, 2) THEN 'fragmentation'
                    WHEN cn % 8 = 4 THEN 'coverage' WHEN cn % 8 = 5 THEN 'border'
                    WHEN cn % 8 = 6 THEN 'sequence' ELSE 'overlap' END AS rule_text,
               CASE WHEN cn % 3 <> 0 OR cn % 8 = 4 THEN NULL
                    WHEN cn % 8 IN (0, 1, 2, 5) THEN '22' WHEN cn % 8 = 3 THEN '21,22'
                    WHEN cn % 8 = 6 THEN '28' ELSE '20,21' END AS label_text
        FROM {v_grid_rows}""",
    # Wide label features per supplier, for reference building.
    "v_wide": """
        SELECT concat('s', l_suppkey) AS case_id, CAST(20 + l_linenumber % 5 AS INT) AS label,
               sum(l_quantity) AS physical_volume_mm3, CAST(count(*) AS DOUBLE) AS extent_x_mm,
               max(l_quantity) AS extent_y_mm, min(l_extendedprice) AS extent_z_mm,
               CASE WHEN l_linenumber % 5 IN (0, 4) THEN NULL ELSE max(l_discount) * 100 END AS curve_offset_mm,
               max(l_extendedprice) AS intensity_mean, min(l_extendedprice) AS intensity_median,
               CAST(max(l_linenumber) AS DOUBLE) AS component_count,
               min(l_tax) AS largest_component_fraction
        FROM {lineitem} GROUP BY l_suppkey, l_linenumber % 5""",
    "v_files": """
        SELECT concat('cohort/', c_mktsegment, '/sub-', c_custkey, '_seg.nii.gz') AS path FROM {customer}
        UNION ALL
        SELECT concat('cohort/', c_mktsegment, '/sub-', c_custkey, '_scan.nii.gz') FROM {customer} WHERE c_acctbal > 0
        UNION ALL
        SELECT concat('cohort/extra/sub-', c_custkey, '_seg.nii.gz') FROM {customer} WHERE c_custkey % 50 = 0
        UNION ALL
        SELECT concat('cohort/misc/broken', c_custkey, '_seg.nii.gz') FROM {customer} WHERE c_custkey % 97 = 1
        UNION ALL
        SELECT concat('cohort/scans/sub-', c_custkey, '.nii.gz') FROM {customer} WHERE c_custkey % 3 = 0""",
    # Mode values of two runs over the same cases (supplier x mode).
    "v_modes": """
        SELECT 'a' AS run_id, concat('s', l_suppkey) AS case_id, CAST(l_linenumber AS INT) AS mode,
               CASE WHEN l_linenumber = 5 THEN NULL ELSE max(l_discount) END AS value
        FROM {lineitem} GROUP BY l_suppkey, l_linenumber
        UNION ALL
        SELECT 'b', concat('s', l_suppkey), CAST(l_linenumber AS INT), max(l_tax) + CAST(l_linenumber % 3 AS DOUBLE) / 4
        FROM {lineitem} GROUP BY l_suppkey, l_linenumber""",
    # Severity ladders: sweep = supplier, rung = return flag, metric = quantity band.
    "v_ladder": """
        SELECT concat('w', l_suppkey) AS sweep_id, CAST(l_linenumber AS INT) AS mode, rung,
               CAST(rung AS DOUBLE) AS severity, metric,
               CASE WHEN metric = 2 THEN 1 - CAST(count(*) AS DOUBLE) / 1000 * rung
                    ELSE CAST(CASE WHEN metric = l_linenumber THEN 4 ELSE 1 END AS DOUBLE) * rung * count(*) END AS value
        FROM (
          SELECT l_suppkey, l_linenumber, CAST(floor(l_quantity / 13) AS INT) AS rung, CAST(l_partkey % 8 + 1 AS INT) AS metric
          FROM {lineitem}
        ) q GROUP BY l_suppkey, l_linenumber, rung, metric""",
}


def dependencies(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Inputs:
    """The adapter views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._frames, self._written = spark, folder, {}, set()

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in BASE_TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = VIEWS[name]
                parts = {d: self.frame(d) for d in dependencies(text)}
                self._frames[name] = self.spark.sql(text, **parts)
        return self._frames[name]

    def written(self, *names: str) -> "Inputs":
        """These views by way of tables, for queries that read them several times; views made of them read the tables."""
        for name in names:
            if name not in self._written:
                self._frames[name] = cut_lineage(self.frame(name))
                self._written.add(name)
        return self

    def _voxels(self, name: str) -> DataFrame:
        return self.frame(name).select("case_id", "x", "y", "z", "label")

    @property
    def voxels(self) -> DataFrame:
        return self._voxels("v_voxels")

    @property
    def candidate(self) -> DataFrame:
        return self._voxels("v_cand")

    @property
    def multi(self) -> DataFrame:
        return self._voxels("v_multi")

    @property
    def scan(self) -> DataFrame:
        return self.frame("v_scan")

    def _with_affine(self, df: DataFrame) -> DataFrame:
        zero, one = F.lit(0.0), F.lit(1.0)
        affine = F.array("sx", zero, zero, zero, zero, "sy", zero, zero, zero, zero, "sz", zero, zero, zero, zero, one)
        return df.drop("cn").withColumn("affine", affine)

    @property
    def grids(self) -> DataFrame:
        return self._with_affine(self.frame("v_grids"))

    @property
    def scan_grids(self) -> DataFrame:
        return self._with_affine(self.frame("v_scan_grids"))

    @property
    def expected(self) -> DataFrame:
        def listed(column: str, kind: str):
            empty = F.array().cast(f"array<{kind}>")
            return F.coalesce(F.split(column, ",").cast(f"array<{kind}>"), empty)

        mode = F.col("failure_mode")
        return self.frame("v_expected").select(
            "case_id", "expected_verdict", listed("rule_text", "string").alias("expected_rule_ids"),
            listed("label_text", "int").alias("expected_labels"), "failure_mode",
            F.when(mode.isNotNull(), F.concat(F.lit("mode "), mode)).alias("failure_mode_name"),
        )

    @property
    def wide(self) -> DataFrame:
        from instqc.operators.inventory import with_levels
        from instqc.schemas import levels

        return with_levels(self.frame("v_wide"), levels(self.spark))

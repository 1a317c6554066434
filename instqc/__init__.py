"""Cohort-scale quality control of instance-labelled volumes on Spark.

A case is a partition key, a label map is a sparse voxel table, and every
feature, rule and score is a DataFrame operator over all cases at once.
"""

from instqc.config import DEFAULT_CONFIG, merge_config
from instqc.session import build_session, cut_lineage, shared_dir

__all__ = ["DEFAULT_CONFIG", "build_session", "cut_lineage", "merge_config", "shared_dir"]

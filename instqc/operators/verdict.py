"""From findings to verdicts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instqc.schemas import FAIL, FLAG, PASS, severity_label

ORDER = ["rule_id", "k1", "k2", "k3"]


def reasons_by_label(findings: DataFrame) -> DataFrame:
    """Reasons per (case, label); label NULL holds the case-level reasons."""
    spread = findings.select(
        "case_id", F.explode_outer("labels").alias("label"),
        F.struct(*ORDER, F.col("reason").alias("message"), "severity").alias("r"),
    )
    return spread.groupBy("case_id", "label").agg(
        F.transform(
            F.array_sort(F.collect_list("r")),
            lambda r: F.struct(r["message"].alias("message"), r["severity"].alias("severity")),
        ).alias("reasons")
    )


def verdicts(
    cases: DataFrame, findings: DataFrame, config: dict[str, Any], base: DataFrame | None = None
) -> DataFrame:
    """One verdict per case: the highest severity over all its reasons.

    ``base`` holds (case_id, reasons ARRAY<STRING>) of the empty-map check;
    each of them fails the case. With an escalation count set, a case without
    a failure but with that many flagged findings fails as well; base reasons
    do not count towards it.
    """
    summary = findings.groupBy("case_id").agg(
        F.max("severity").alias("_top"), F.count_if(F.col("severity") == FLAG).alias("n_flag"),
        F.count(F.lit(1)).alias("n_findings"),
    )
    by_label = reasons_by_label(findings)
    own = by_label.filter(F.col("label").isNull()).select("case_id", F.col("reasons").alias("_own"))
    per_label = by_label.filter(F.col("label").isNotNull()).groupBy("case_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "reasons")))).alias("per_label")
    )
    reason_type = "array<struct<message:string,severity:int>>"
    df = cases.select("case_id").join(summary, "case_id", "left").join(own, "case_id", "left").join(
        per_label, "case_id", "left"
    )
    if base is not None:
        failing = base.select("case_id", F.transform("reasons", lambda m: F.struct(
            m.alias("message"), F.lit(FAIL).alias("severity"))).alias("_base"))
        df = df.join(failing, "case_id", "left")
    else:
        df = df.withColumn("_base", F.lit(None).cast(reason_type))
    df = df.withColumn("_base", F.coalesce("_base", F.array().cast(reason_type)))
    top = F.greatest(F.coalesce("_top", F.lit(PASS)), F.when(F.size("_base") > 0, FAIL).otherwise(PASS))
    n_flag = F.coalesce("n_flag", F.lit(0))
    limit = int(config.get("verdict", {}).get("flag_escalation_count", 0))
    escalate = (F.lit(limit) > 0) & (top != FAIL) & (n_flag > 0) & (n_flag >= limit)
    message = F.format_string(
        "%d review-level findings meet the escalation threshold (%d); verdict escalated to fail.",
        n_flag, F.lit(limit),
    )
    extra = F.when(
        escalate, F.array(F.struct(message.alias("message"), F.lit(FAIL).alias("severity")))
    ).otherwise(F.array().cast(reason_type))
    overall = F.when(escalate, FAIL).otherwise(top).cast("int")
    return df.select(
        "case_id",
        overall.alias("overall"),
        severity_label(overall).alias("verdict"),
        F.concat("_base", F.coalesce("_own", F.array().cast(reason_type)), extra).alias("reasons"),
        "per_label",
        n_flag.alias("n_flag"),
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
    )

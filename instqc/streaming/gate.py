"""Judging cases as they arrive, each exactly once."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.errors import AnalysisException

from instqc.functions.skew import of_cases
from instqc.plans.judge import judge
from instqc.schemas import VOXELS

#: One row per case: how many voxel rows its files hold in all, 0 for an empty map.
MANIFEST = "case_id string, n_voxels long"
#: What is known of the cases that wait: a row per file of a case, and one with an empty name for its manifest row.
LEDGER = "case_id string, name string, path string, batch long, n long, expected long"
DEAD = "case_id string, reason string, expected long, arrived long, unique_rows long, batch_id long"
VERDICTS = "case_id string, overall int, verdict string, n_flag long, n_findings long, batch_id long"
STAGED = "case_id string, x int, y int, z int, label int, path string, expected long, bucket int, batch long"
#: Staged rows are ordered by so many buckets of cases.
BUCKETS = 1024


def arrivals(spark: SparkSession, incoming: str, manifest: str, files_per_batch: int) -> DataFrame:
    """Stream of voxel rows and manifest rows (``expected`` set), each with the file it came in."""
    def source(schema, path: str) -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn(
            "path", F.col("_metadata.file_path"))

    columns = ["case_id", "x", "y", "z", "label", "path", "expected"]
    voxels = source(VOXELS, incoming).withColumn("expected", F.lit(None).cast("long"))
    listed = source(MANIFEST, manifest).select("case_id", F.col("n_voxels").alias("expected"), "path")
    for c in ("x", "y", "z", "label"):
        listed = listed.withColumn(c, F.lit(None).cast("int"))
    return voxels.select(*columns).unionByName(listed.select(*columns))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of folders per batch, empty as long as nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _staged(spark: SparkSession, out: str, batches: list[int]) -> DataFrame:
    paths = [f"{out}/staged/batch={b}" for b in batches]
    return spark.read.schema(STAGED).option("basePath", f"{out}/staged").parquet(*paths) if paths else spark.createDataFrame([], STAGED)


def _stage(batch: DataFrame, out: str, batch_id: int) -> DataFrame:
    """Keep the batch's rows, in order of their bucket, so that row groups can be skipped by it; gives its ledger rows.

    Rows are dealt by bucket into tables of even size first, so that tasks and
    what they sort do not grow with the files that came. The ledger rows are
    written, as they are read several times.
    """
    bucket = F.pmod(F.xxhash64("case_id"), F.lit(BUCKETS)).cast("int")
    dealt = batch.withColumn("bucket", bucket).hint("rebalance", F.col("bucket"))
    dealt.sortWithinPartitions("bucket", "case_id").write.mode("overwrite").parquet(f"{out}/staged/batch={batch_id}")
    rows = _staged(batch.sparkSession, out, [batch_id])
    name = F.when(F.col("expected").isNull(), F.element_at(F.split("path", "/"), -1)).otherwise("")
    news = rows.groupBy("case_id", "path", name.alias("name")).agg(
        F.count("label").alias("n"), F.max("expected").alias("expected")
    ).select("case_id", "name", "path", F.lit(batch_id).cast("long").alias("batch"), "n", "expected")
    return _written(news, f"{out}/news/batch={batch_id}", LEDGER)


def _latest(ledger: DataFrame) -> DataFrame:
    """One row per case and file name: the last delivery counts, in place of those before."""
    last = F.max(F.struct("batch", "path", "n", "expected")).alias("_l")
    return ledger.groupBy("case_id", "name").agg(last).select("case_id", "name", "_l.path", "_l.batch", "_l.n", "_l.expected")


def _rows(spark: SparkSession, out: str, ledger: DataFrame, cases: DataFrame) -> DataFrame:
    """The distinct voxel rows of some cases, from the deliveries that count.

    Only the batches in which they got files are read, and of these the row
    groups with their buckets, which are at most BUCKETS numbers.
    """
    wanted = ledger.join(cases, "case_id", "left_semi").filter("name <> ''")
    where = wanted.select("batch", F.pmod(F.xxhash64("case_id"), F.lit(BUCKETS)).cast("int").alias("bucket")).agg(
        F.collect_set("batch").alias("batches"), F.collect_set("bucket").alias("buckets")).first()
    staged = _staged(spark, out, where["batches"]).filter(F.col("bucket").isin(where["buckets"]))
    rows = of_cases(staged.filter("expected IS NULL"), cases)
    return rows.join(wanted.select("case_id", "path", "batch"), ["case_id", "path", "batch"], "left_semi").select(
        *[f.name for f in VOXELS.fields]).distinct()


def start_gate(
    spark: SparkSession,
    incoming: str,
    manifest: str,
    grids: DataFrame,
    out: str,
    checkpoint: str,
    config: dict[str, Any] | None = None,
    files_per_batch: int = 1000,
    once: bool = False,
) -> StreamingQuery:
    """Stream voxel files and manifest rows; write verdicts and findings of cases that are complete.

    The manifest names every case with its number of voxel rows; the last row
    for a case counts. A case may come in many files and over many batches and
    is judged once, in the batch that completes it. A case of 0 rows is judged
    as the empty map it is. ``grids`` has a row for every case.

    What waits is kept as a ledger with a row per case and file, rewritten by
    each batch from the one before without the cases it has judged, so it
    grows with the cases in flight and not with all that came. A file that is
    delivered again under its name replaces its former delivery. Rows that
    stand in several files of a case count once. Three kinds of case get a row
    with a reason in ``dead_letters``: one with more distinct rows than its
    manifest says, which goes on waiting for a corrected manifest or file; one
    of which something arrives after its verdict, which stands; and one that
    is complete but has no grid, which is closed.

    Each batch writes to folders of its own in overwrite mode and reads only
    those of batches before it, so a batch repeated after a failure leaves
    nothing twice.
    """
    def judge_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        news = _stage(batch, out, batch_id)
        before = _table(session, f"{out}/ledger/version={batch_id - 1}", LEDGER)
        closed = lambda name, schema: _table(session, f"{out}/{name}", schema).filter(F.col("batch_id") < batch_id)
        done = closed("verdicts", VERDICTS).select("case_id").unionByName(
            closed("dead_letters", DEAD).filter("reason = 'no grid'").select("case_id"))
        merged = _latest(before.unionByName(news))
        ledger = _written(merged.join(done, "case_id", "left_anti"), f"{out}/merged/batch={batch_id}", LEDGER)
        late = news.join(done, "case_id", "left_semi").groupBy("case_id").agg(F.sum("n").alias("arrived")).select(
            "case_id", F.lit("arrived after its verdict").alias("reason"), F.lit(None).cast("long").alias("expected"), "arrived",
            F.lit(None).cast("long").alias("unique_rows"))

        sums = ledger.groupBy("case_id").agg(F.max("expected").alias("expected"), F.sum("n").alias("arrived"), F.max("batch").alias("_last"))
        full = _written(
            sums.filter((F.col("arrived") >= F.col("expected")) & (F.col("_last") == batch_id)).drop("_last"),
            f"{out}/full/batch={batch_id}", "case_id string, expected long, arrived long")
        late.write.mode("overwrite").parquet(f"{out}/dead_letters/batch_id={batch_id}")
        if not full.take(1):
            ledger.write.mode("overwrite").parquet(f"{out}/ledger/version={batch_id}")
            return
        rows = _written(_rows(session, out, ledger, full.select("case_id")), f"{out}/rows/batch={batch_id}", VOXELS)
        unique = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("unique_rows"))
        sizes = full.join(unique, "case_id", "left").withColumn("unique_rows", F.coalesce("unique_rows", F.lit(0).cast("long")))
        has_grid = grids.select("case_id").distinct().withColumn("_grid", F.lit(True))
        sizes = _written(
            sizes.join(has_grid, "case_id", "left"), f"{out}/sizes/batch={batch_id}",
            "case_id string, expected long, arrived long, unique_rows long, _grid boolean")
        complete = sizes.filter("unique_rows = expected")
        ready = complete.filter("_grid").select("case_id")
        errors = sizes.filter("unique_rows > expected").withColumn("reason", F.lit("more rows than its manifest says")).unionByName(
            complete.filter("_grid IS NULL").withColumn("reason", F.lit("no grid")))
        late.unionByName(errors.select(*late.columns)).write.mode("overwrite").parquet(f"{out}/dead_letters/batch_id={batch_id}")
        if ready.take(1):
            judged = judge(of_cases(rows, ready).filter("label <> 0"), grids.join(ready, "case_id", "left_semi"), config)
            judged.findings.write.mode("overwrite").parquet(f"{out}/findings/batch_id={batch_id}")
            judged.verdicts.select("case_id", "overall", "verdict", "n_flag", "n_findings").write.mode("overwrite").parquet(
                f"{out}/verdicts/batch_id={batch_id}")
        ledger.join(complete.select("case_id"), "case_id", "left_anti").write.mode("overwrite").parquet(f"{out}/ledger/version={batch_id}")

    writer = arrivals(spark, incoming, manifest, files_per_batch).writeStream.foreachBatch(judge_batch).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _written(df: DataFrame, path: str, schema) -> DataFrame:
    """``df`` by way of a table, as several steps of a batch read it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)

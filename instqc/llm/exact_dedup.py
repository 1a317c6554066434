"""Exact deduplication as a stateful stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from instqc.llm.common import only_keys
from instqc.session import cut_lineage, scratch_path

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: else each reserves megabytes of disk in advance.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def located(frame: DataFrame, digest_bits: int) -> DataFrame:
    """doc_id, text (null as empty), sha256, the digest that keys the state, and where the row lies."""
    text = F.coalesce("text", F.lit(""))
    return frame.select(
        F.col("doc_id"), text.alias("text"), F.sha2(text, 256).alias("sha256"),
        F.struct(F.col("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("who"),
    ).withColumn("digest", F.substring("sha256", 1, digest_bits // 4))


def update_state(spark: SparkSession, path: str, checkpoint: str, log: str, *, digest_bits: int = 256, batch_bytes: int = 64 << 30) -> None:
    """Take in what is new under ``path`` since the last call.

    State per digest: the row with the largest doc_id so far, its file and row
    number, and the count of rows. It lies in RocksDB on the executors' disks
    with change logs under ``checkpoint``, has no watermark and so never
    expires. Rows are combined per task before the shuffle, which keeps a
    digest with very many copies small. Each batch writes the states it
    changed to a folder of its own, in overwrite mode, so a repeated batch
    leaves one result.
    """
    before = {key: spark.conf.get(key, None) for key in ROCKSDB}
    for key, value in ROCKSDB.items():
        spark.conf.set(key, value)
    try:
        schema = spark.read.parquet(path).schema
        # As a pattern, the path may also name a single file.
        pattern = f"{path[:-1]}[{path[-1]}]"
        rows = located(spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(pattern), digest_bits)
        state = rows.groupBy("digest").agg(F.max("who").alias("keeper"), F.count("*").alias("n"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{log}/batch={number}")

        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(keep).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


STATE = "digest string, keeper struct<doc_id: bigint, file: string, row: bigint>, n bigint, batch bigint"


def current_state(spark: SparkSession, log: str) -> DataFrame:
    """One row per digest: digest, keeper, n as of its last change."""
    changes = spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(log)
    last = changes.groupBy("digest").agg(F.max(F.struct("batch", "n", "keeper")).alias("_last"))
    return last.select("digest", F.col("_last.keeper").alias("keeper"), F.col("_last.n").alias("n"))


def dedup(spark: SparkSession, path: str, *, digest_bits: int = 256, batch_bytes: int = 64 << 30) -> DataFrame:
    """One row per row of the documents under ``path``.

    Texts are equal if identical; null counts as the empty text. Of equal
    texts the row with the largest doc_id stays (null ids are smallest; of
    rows with one id, the last by file and row number). Columns: doc_id,
    keep_id, group_size, kept, text_sha256.

    A digest seen more than once is a hit, and hits are checked on full bytes:
    least and greatest text of each such digest must agree, which is reduced
    per task before the shuffle. Digests under which texts differ are grouped
    by the text itself.
    """
    if not spark.read.parquet(path).take(1):
        empty = "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"
        return spark.createDataFrame([], empty)
    checkpoint, log = scratch_path(spark, "dedup-state"), scratch_path(spark, "dedup-log")
    update_state(spark, path, checkpoint, log, digest_bits=digest_bits, batch_bytes=batch_bytes)
    state = cut_lineage(current_state(spark, log))
    rows = located(spark.read.parquet(path), digest_bits)

    hits = only_keys(rows.select("digest", "text"), state.filter("n > 1"), ["digest"])
    checked = hits.groupBy("digest").agg(F.min("text").alias("_a"), F.max("text").alias("_b"))
    differing = cut_lineage(checked.filter("_a <> _b").select("digest"))

    plain = rows.select("doc_id", "sha256", "digest", "who").join(state.join(differing, "digest", "left_anti"), "digest")
    result = plain.select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("who") == F.col("keeper")).alias("kept"), F.col("sha256").alias("text_sha256"),
    )
    if differing.take(1):
        clashing = cut_lineage(only_keys(rows, differing, ["digest"]))
        groups = clashing.groupBy("text").agg(F.max("who").alias("keeper"), F.count("*").alias("n"))
        result = result.unionByName(clashing.join(groups, "text").select(
            "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("who") == F.col("keeper")).alias("kept"), F.col("sha256").alias("text_sha256"),
        ))
    return result

"""Structured Streaming jobs over the same transformations as the batch plans.

Sinks are Parquet folders in shared storage. Update-mode results are written per micro-batch under a batch number that is
overwritten on replay, and ``snapshot`` keeps the newest row per key, so a restarted query neither loses nor repeats rows.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlens.operators import aggregates, siblings, validation
from dossierlens.plans.processing import dead_letter, understand
from dossierlens.storage import WorkFolder, stage

LEDGER_BUCKETS = 64


def file_stream(spark: SparkSession, path: str, schema, name_filter: str = None, max_files: int = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _trigger(writer, interval):
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", interval: str = None):
    """Write every micro-batch to ``path/batch=<n>``; a replayed batch overwrites itself."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return _trigger(writer, interval).start()


def snapshot(spark: SparkSession, path: str, keys: list) -> DataFrame:
    """Newest row per key of an update-mode result."""
    rows = spark.read.option("basePath", path).parquet(path)
    fields = [c for c in rows.columns if c not in (*keys, "batch")]
    if not keys:
        latest = rows.agg(F.max_by(F.struct(*fields), "batch").alias("_row"))
    else:
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("_row"))
    return latest.select(*keys, "_row.*")


def stream_understanding(documents: DataFrame, path: str, errors_path: str, checkpoint: str, interval: str = None):
    """Classify and extract documents as they arrive; unreadable ones go to the error folder."""
    def save(batch: DataFrame, batch_id: int) -> None:
        good, bad = dead_letter(batch)
        understand(good).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{errors_path}/batch={batch_id}")

    writer = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return _trigger(writer, interval).start()


def stream_compliance(anomalies: DataFrame) -> DataFrame:
    """Open and critical anomalies per supplier with the resulting status, for update mode."""
    open_ = ~F.col("resolved")
    counts = anomalies.groupBy("supplier_id").agg(
        F.count_if(open_).alias("unresolved"),
        F.count_if(open_ & (F.col("severity") == "error")).alias("critical"))
    return counts.withColumn("compliance_status", aggregates.status_of(F.col("unresolved"), F.col("critical")))


def stream_dashboard(documents: DataFrame) -> DataFrame:
    """Documents per status, for update mode."""
    return documents.groupBy("status").agg(F.count("*").alias("n"))


def stream_dedupe(documents: DataFrame, delay: str = "1 day", time_col: str = "upload_timestamp") -> DataFrame:
    """Drop repeated document ids that arrive within the watermark delay, which bounds the state."""
    return documents.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["document_id"])


def stream_status_latest(events: DataFrame) -> DataFrame:
    return aggregates.status_latest(events)


class SiblingLedger:
    """What the sibling check of a stream has to remember: per (supplier, SIRET) the number of siblings and the smallest one.

    The counts lie in ``buckets`` by supplier. A batch reads the newest version of the buckets that its suppliers fall into, adds
    its own counts, and writes those buckets as a new version under its number, together with a list of the newest version of
    every bucket. The documents of earlier batches are never read again, so a batch costs its own documents and the groups (not
    documents) of the buckets it touches. A replayed batch starts from the list of the batch before it and writes the same again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEDGER_BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def versions(self, batch_id: int) -> dict:
        """Bucket -> number of the batch that wrote it last, as of the end of a batch; empty before the first."""
        if batch_id < 0:
            return {}
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version long").json(f"{self.path}/list/batch={batch_id}").collect()}

    def add(self, counted: DataFrame, batch_id: int) -> DataFrame:
        """Add a batch's counts (``siblings.siret_counts``); returns all groups of the suppliers of the batch."""
        spark, known = self.spark, self.versions(batch_id - 1)
        bucket = F.pmod(F.xxhash64("supplier_id"), F.lit(self.buckets)).cast("int")
        fields = [*siblings.GROUP, "n_siblings", "first"]
        with WorkFolder(spark) as work:
            new = stage(counted.select(*fields, bucket.alias("bucket")), "batch_counts", work)
            touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # one per bucket at most
            groups = new
            for version in sorted({known[b] for b in touched if b in known}):
                of_version = [b for b in touched if known.get(b) == version]
                groups = groups.unionByName(spark.read.schema(new.schema).option("basePath", f"{self.path}/groups/batch={version}").parquet(
                    *[f"{self.path}/groups/batch={version}/bucket={b}" for b in of_version]))
            merged = groups.groupBy("bucket", *siblings.GROUP).agg(F.sum("n_siblings").alias("n_siblings"), F.min("first").alias("first"))
            target = f"{self.path}/groups/batch={batch_id}"
            merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        newest = known | {b: batch_id for b in touched}
        spark.createDataFrame(sorted(newest.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(
            f"{self.path}/list/batch={batch_id}")
        written = spark.read.schema(merged.schema).parquet(target)
        return written.join(counted.select("supplier_id").distinct(), "supplier_id", "left_semi").drop("bucket")


def check_siblings(batch: DataFrame, batch_id: int, silver: str, conflicts: str, ledger: SiblingLedger) -> None:
    """Store a batch's documents as far as the check needs them, and the state of every conflict its suppliers are in."""
    rows = siblings.comparable(batch).drop("fresh")
    rows.write.mode("overwrite").parquet(f"{silver}/batch={batch_id}")
    stored = batch.sparkSession.read.schema(rows.schema).parquet(f"{silver}/batch={batch_id}")
    groups = ledger.add(siblings.siret_counts(stored.withColumn("fresh", F.lit(True))), batch_id)
    siblings.group_conflicts(groups.withColumn("n_fresh", F.lit(0).cast("bigint"))).drop("n_fresh").write.mode("overwrite").parquet(
        f"{conflicts}/batch={batch_id}")


def stream_sibling_check(documents: DataFrame, silver: str, conflicts: str, ledger: str, checkpoint: str, interval: str = None):
    """Compare each micro-batch with all documents so far and with itself, at the cost of the batch's own suppliers.

    A batch writes its slim documents and, per (supplier, SIRET) of its suppliers, what those documents now conflict with. That
    restates documents of earlier batches without reading them: ``sibling_findings`` looks every document's group up.
    """
    def check(batch: DataFrame, batch_id: int) -> None:
        check_siblings(batch, batch_id, silver, conflicts, SiblingLedger(batch.sparkSession, ledger))

    writer = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(check)
    return _trigger(writer, interval).start()


def sibling_findings(spark: SparkSession, silver: str, conflicts: str, as_of: datetime) -> DataFrame:
    """One anomaly per document that conflicts with a sibling, as of the newest batch."""
    rows = spark.read.option("basePath", silver).parquet(silver).drop("batch").withColumn("fresh", F.lit(True))
    newest = snapshot(spark, conflicts, siblings.GROUP).withColumn("n_fresh", F.lit(0).cast("bigint"))
    return validation.stamp_anomalies(validation.mismatch_findings(siblings.mismatching(rows, newest)), as_of)

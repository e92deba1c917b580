"""Writers of the zones and set-wise updates of tables.

Updates return the new state of a table; the caller writes it as a new snapshot (or hands it to ``MERGE`` where the table
format has it). Nothing is changed in place, so a failed job can simply run again.
"""

from pyspark.sql import DataFrame, functions as F

from dossierlens.operators import filters
from dossierlens.operators.training import training_verdict

CURATED_FIELDS = [
    "document_id", "supplier_id", "original_filename", "doc_type", "classification_confidence", "extracted",
    "validation", "ocr_quality_score",
]


def write_clean(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Recognised text and its metadata, partitioned by month of ingestion.

    The rebalance hint gathers the rows of a month before the write, so a month does not get one file per task, and lets
    adaptive execution split a month that is much larger than the others.
    """
    docs.select(
        "document_id", F.col("ocr_text").alias("text"), "ocr_quality_score",
        F.date_format("upload_timestamp", "yyyy-MM").alias("ingest_month")
    ).hint("rebalance", "ingest_month").write.mode(mode).partitionBy("ingest_month").parquet(path)


def curated_record(docs: DataFrame, as_of) -> DataFrame:
    return docs.select(*CURATED_FIELDS, F.lit(as_of).alias("processed_at"))


def write_curated(docs: DataFrame, path: str, as_of, mode: str = "overwrite") -> None:
    """Final JSON records by type, compressed, as the names of the fields are most of a record; absent fields are left out."""
    curated_record(docs, as_of).hint("rebalance", "doc_type").write.mode(mode).option("compression", "gzip").partitionBy(
        "doc_type").json(path)


def append_anomalies(anomalies: DataFrame, path: str) -> None:
    anomalies.write.mode("append").parquet(path)


def write_training_set(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.select("text", "label").write.mode(mode).json(path)


def manifest(planned: DataFrame, root: str) -> DataFrame:
    """File-level metadata of generated documents."""
    base = F.concat(F.lit(root.rstrip("/") + "/"), F.col("siret"), F.lit("/"), F.lower("doc_type"))
    return planned.select(
        F.col("name").alias("company_name"), "siret", "siren", "doc_type", "degradation", "severity",
        F.concat(base, F.lit(".pdf")).alias("pdf_path"), F.concat(base, F.lit("_scan.jpg")).alias("jpg_path"))


def write_manifest(planned: DataFrame, root: str, path: str, mode: str = "overwrite") -> None:
    manifest(planned, root).write.mode(mode).json(path)


def training_report(metrics: DataFrame, cv_summary: DataFrame, report: DataFrame) -> DataFrame:
    """Long form ``scope, name, value`` of overall metrics and per-class scores, with the verdict as a scope of its own."""
    judged = metrics.withColumn("verdict", training_verdict(F.col("accuracy"), F.col("f1_macro")))

    def overall(df, names):
        return df.select(F.inline(F.array(*[F.struct(
            F.lit("overall").alias("scope"), F.lit(n).alias("name"), F.col(n).cast("string").alias("value"))
            for n in names])))

    per_class = report.select(F.inline(F.array(*[F.struct(
        F.col("class").cast("string").alias("scope"), F.lit(n).alias("name"), F.col(n).cast("string").alias("value"))
        for n in ("precision", "recall", "f1", "support")])))
    return overall(judged, ["accuracy", "f1_macro", "f1_weighted", "avg_confidence_correct", "n_test", "verdict"]).unionByName(
        overall(cv_summary, cv_summary.columns)).unionByName(per_class)


def write_training_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.write.mode(mode).json(path)


def merge_documents(target: DataFrame, updates: DataFrame, key: str = "document_id", order: list = ()) -> DataFrame:
    """Partial update: non-null columns of the update replace those of the document with the same key, the last one in ``order``
    where there are several."""
    return filters.sparse_update(target, updates, key, order=order)


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str, order: list = ()) -> DataFrame:
    """Rows whose key is not stored yet. Of several new rows of a key the first in ``order`` is inserted, as if they had come one
    by one; without an order, or at the same place of it, the one whose JSON text is smallest. Rows of null key are one key."""
    row = F.struct(*new.columns)
    place = F.struct(*order, F.to_json(row, {"ignoreNullFields": "false"}).alias("_tie"))
    first = new.groupBy(key).agg(F.min_by(row, place).alias("_row")).select("_row.*").select(*new.columns)
    return first.join(existing.select(key), key, "left_anti")


def conflicts(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return new.join(existing.select(key), key, "left_semi")


def delete_cascade(docs: DataFrame, anomalies: DataFrame, ids: DataFrame):
    """``(documents, anomalies)`` without the listed documents."""
    gone = ids.select("document_id")
    return docs.join(gone, "document_id", "left_anti"), anomalies.join(gone, "document_id", "left_anti")


def resolve_anomalies(anomalies: DataFrame, resolutions: DataFrame, as_of) -> DataFrame:
    """Set or clear ``resolved`` for the listed anomalies (``anomaly_id, resolved``)."""
    wanted = resolutions.select("anomaly_id", F.col("resolved").alias("_resolved"))
    joined = anomalies.join(wanted, "anomaly_id", "left")
    listed = F.col("_resolved").isNotNull()
    return joined.withColumns({
        "resolved_at": F.when(listed, F.when(F.col("_resolved"), F.lit(as_of))).otherwise(F.col("resolved_at")),
        "resolved": F.coalesce("_resolved", "resolved"),
    }).select(*anomalies.columns)

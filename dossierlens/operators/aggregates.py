"""Dashboard, compliance and coverage aggregates.

All of them are counts, sums or ``max_by``/``min_by``, which combine before the shuffle: a supplier that holds a third of
the table contributes one partial row per task.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from dossierlens import schemas
from dossierlens.functions import dates
from dossierlens.operators import extraction, filters

EXPIRING_SOON_DAYS = 30
# Which extracted field proposes which supplier column.
AUTOFILL = {
    "siret": "siret", "siren": "siren", "tva_number": "tva_number", "raison_sociale": "name", "adresse": "address",
}


def dashboard_stats(docs: DataFrame, suppliers: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Ten counts in one row. Each table is scanned once; the three one-row results meet in an aggregate."""
    status, open_ = F.col("status"), ~F.col("resolved")
    parts = [
        docs.agg(
            F.count("*").alias("total_documents"),
            F.count_if(status == "processed").alias("documents_processed"),
            F.count_if(status.isin(schemas.OPEN_STATUSES)).alias("documents_pending"),
            F.count_if(status == "error").alias("documents_error")),
        suppliers.agg(
            F.count("*").alias("total_suppliers"),
            F.count_if(F.col("compliance_status") != "pending").alias("active_suppliers")),
        anomalies.agg(
            F.count("*").alias("total_anomalies"),
            F.count_if(open_).alias("unresolved_anomalies"),
            F.count_if(open_ & (F.col("severity") == "error")).alias("critical_anomalies"),
            F.count_if(open_ & F.col("type").isin(schemas.EXPIRY_TYPES)).alias("documents_expiring_soon")),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, zero when there is nothing to divide by."""
    return F.coalesce(F.floor(F.try_divide(part * 100, whole) + F.lit(0.5)), F.lit(0)).cast("bigint")


def processed_rate(stats: DataFrame) -> DataFrame:
    return stats.select(percent(F.col("documents_processed"), F.col("total_documents")).alias("processed_rate"))


def status_of(unresolved: Column, critical: Column) -> Column:
    return (
        F.when(critical > 0, F.lit("non_compliant")).when(unresolved > 0, F.lit("warning"))
        .otherwise(F.lit("compliant"))
    )


def open_anomaly_counts(anomalies: DataFrame, info_counts: bool = True) -> DataFrame:
    """Per supplier ``unresolved`` and ``critical``; without ``info_counts`` only errors and warnings count."""
    counted = anomalies.where(~F.col("resolved"))
    if not info_counts:
        counted = counted.where(F.col("severity").isin("error", "warning"))
    return counted.groupBy("supplier_id").agg(
        F.count("*").alias("unresolved"), F.count_if(F.col("severity") == "error").alias("critical"))


def supplier_compliance_status(anomalies: DataFrame, suppliers: DataFrame, info_counts: bool = True) -> DataFrame:
    """Suppliers with ``compliance_status`` recomputed from their open anomalies."""
    counts = open_anomaly_counts(anomalies, info_counts)
    joined = suppliers.drop("compliance_status").join(counts, "supplier_id", "left")
    zero = F.lit(0)
    return joined.withColumn("compliance_status", status_of(
        F.coalesce("unresolved", zero), F.coalesce("critical", zero))).drop("unresolved", "critical")


def compliance_overview(suppliers: DataFrame, docs: DataFrame, anomalies: DataFrame, as_of: datetime) -> DataFrame:
    # One field of the struct, then its day count, before the aggregate: so the scan reads what that field needs, no more.
    left = docs.select("supplier_id", dates.days_until(dates.parse_iso(F.col("extracted.date_expiration")), as_of).alias("days"))
    expiry = left.groupBy("supplier_id").agg(
        F.count("*").alias("total_documents"),
        F.count_if(F.col("days") < 0).alias("expired_documents"),
        F.count_if(F.col("days").between(0, EXPIRING_SOON_DAYS)).alias("expiring_soon"))
    counts = open_anomaly_counts(anomalies)
    joined = suppliers.select("supplier_id", F.col("name").alias("supplier_name"), "compliance_status").join(
        counts, "supplier_id", "left").join(expiry, "supplier_id", "left")

    def zero(c):
        return F.coalesce(c, F.lit(0).cast("bigint"))

    return joined.select(
        "supplier_id", "supplier_name", "compliance_status", zero("unresolved").alias("anomaly_count"),
        zero("critical").alias("critical_anomalies"), zero("total_documents").alias("total_documents"),
        zero("expired_documents").alias("expired_documents"), zero("expiring_soon").alias("expiring_soon"),
        F.lit(as_of).alias("last_check"))


def supplier_validity_rate(overview: DataFrame) -> DataFrame:
    total = F.col("total_documents")
    return overview.select("supplier_id", percent(
        total - F.col("expired_documents"), F.greatest(total, F.lit(1))).alias("validity_rate"))


def compliance_distribution(suppliers: DataFrame) -> DataFrame:
    """Suppliers per status, in one row, with the share of compliant ones."""
    def status(value):
        return F.count_if(F.col("compliance_status") == value)

    counts = suppliers.agg(
        F.count("*").alias("total"), status("compliant").alias("compliant"), status("warning").alias("warning"),
        status("non_compliant").alias("non_compliant"), status("pending").alias("pending"))
    return counts.withColumn("compliance_rate", percent(F.col("compliant"), F.col("total")))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(3)


def anomalies_by_severity(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("severity").agg(F.count("*").alias("n")).withColumn(
        "severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank")


def with_days_left(anomalies: DataFrame, as_of: datetime) -> DataFrame:
    days = dates.full_days_until(dates.parse_iso(dates.details_date(F.col("details"))), as_of)
    return anomalies.withColumn("days_left", days).withColumn("bucket", dates.expiry_bucket(F.col("days_left")))


def bucket_rank(bucket: Column) -> Column:
    return (
        F.when(bucket == "expired", 0).when(bucket == "critical", 1).when(bucket == "urgent", 2).otherwise(3)
    )


def order_by_days_left(anomalies: DataFrame, as_of: datetime) -> DataFrame:
    return with_days_left(anomalies, as_of).withColumn("bucket_rank", bucket_rank(F.col("bucket"))).orderBy(
        "bucket_rank", F.asc_nulls_last("days_left"), "anomaly_id")


def expiration_buckets(anomalies: DataFrame, as_of: datetime) -> DataFrame:
    return with_days_left(filters.expiration_anomalies(anomalies), as_of).groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("days_left").alias("min_days_left"), F.max("days_left").alias("max_days_left"))


def run_state_counts(runs: DataFrame, ids: DataFrame) -> DataFrame:
    def state(value):
        return F.count_if(F.col("state") == value).alias(value)

    return runs.join(ids.select("document_id"), "document_id", "left_semi").agg(
        state("success"), state("running"), state("failed"), state("queued"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per label; the total is a scalar subquery over the same grouped counts."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def supplier_autofill(suppliers: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame:
    """Supplier columns overridden by the first non-empty value among the newest processed documents."""
    newest = filters.latest_n_per_supplier(docs, n)
    proposals = newest.groupBy("supplier_id").agg(*[
        F.min_by(F.col("extracted")[field], F.when(F.col("extracted")[field] != "", F.col("recency"))).alias(f"_{column}")
        for field, column in AUTOFILL.items()])
    joined = suppliers.join(proposals, "supplier_id", "left")
    return joined.select(*[
        F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in AUTOFILL.values() else F.col(c)
        for c in suppliers.columns])


def extraction_coverage(docs: DataFrame) -> DataFrame:
    return docs.select("doc_type", extraction.fields_found(F.col("extracted")).alias("found")).groupBy("doc_type").agg(
        F.count("*").alias("n_documents"), F.avg("found").alias("avg_fields"))


def status_latest(events: DataFrame) -> DataFrame:
    """Latest status per document; also valid on a streaming input in update mode."""
    return events.groupBy("document_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))

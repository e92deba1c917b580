"""Look-ups between documents, suppliers and anomalies, and constant-table expansions.

No side is hinted as broadcast: the supplier table grows with the data, so the choice is left to Spark, which compares the
measured size with its threshold and splits skewed partitions at run time. Constant tables are literals of the plan.
"""

from pyspark.sql import Column, DataFrame, functions as F

from dossierlens.operators import ranking

# Noise bands ``(upper bound of the roll, lowest severity, highest severity)``.
NOISE_SCHEDULE = [(0.45, None, None), (0.75, 0.15, 0.35), (0.95, 0.35, 0.60), (1.00, 0.60, 0.85)]
# Documents planned per supplier ``(type, anomaly, degradation, severity)``.
REGULAR_PLAN = [
    ("FACTURE", None, "high_quality", 0.1), ("DEVIS", None, "noise", 0.3),
    ("URSSAF", None, "high_quality", 0.1), ("RIB", None, "high_quality", 0.1),
]
ANOMALY_PLAN = [
    ("FACTURE", "bad_siret", "blur", 0.4), ("KBIS", "expired", "low_resolution", 0.6),
    ("URSSAF", "expired", "blur", 0.5), ("RIB", None, "high_quality", 0.1),
]
# Degradation used when every type is generated once per company.
TYPE_DEGRADATION = {
    "FACTURE": ("high_quality", 0.1), "DEVIS": ("noise", 0.3), "KBIS": ("rotation", 0.2),
    "URSSAF": ("high_quality", 0.1), "SIRET": ("high_quality", 0.1), "RIB": ("high_quality", 0.1),
}


def enrich_anomalies(anomalies: DataFrame, suppliers: DataFrame) -> DataFrame:
    names = suppliers.select("supplier_id", F.col("name").alias("supplier_name"))
    return anomalies.join(names, "supplier_id", "left")


def require_supplier(docs: DataFrame, suppliers: DataFrame):
    """``(accepted, rejected)`` documents by existence of their supplier."""
    known = suppliers.select("supplier_id")
    return docs.join(known, "supplier_id", "left_semi"), docs.join(known, "supplier_id", "left_anti")


def with_document_count(suppliers: DataFrame, docs: DataFrame) -> DataFrame:
    counts = docs.groupBy("supplier_id").agg(F.count("*").alias("document_count"))
    return suppliers.join(counts, "supplier_id", "left").withColumn(
        "document_count", F.coalesce("document_count", F.lit(0).cast("bigint")))


def lookup_band(roll: Column, schedule: list = None) -> Column:
    """First band whose upper bound exceeds the roll, as ``struct<band, severity_lo, severity_hi>``."""
    chain = F
    for i, (upper, low, high) in enumerate(schedule or NOISE_SCHEDULE):
        chain = chain.when(roll < upper, F.struct(
            F.lit(i).alias("band"), F.lit(low).cast("double").alias("severity_lo"),
            F.lit(high).cast("double").alias("severity_hi")))
    return chain


def _plan(rows: list) -> Column:
    return F.array(*[F.struct(
        F.lit(t).alias("doc_type"), F.lit(a).cast("string").alias("anomaly"),
        F.lit(d).alias("degradation"), F.lit(s).alias("severity")) for t, a, d, s in rows])


def expand_document_plan(suppliers: DataFrame) -> DataFrame:
    """Every supplier with its planned documents; each third supplier in key order follows the anomaly plan."""
    numbered = ranking.global_row_number(suppliers, "supplier_id", "supplier_index")
    plan = F.when(F.col("supplier_index") % 3 == 2, _plan(ANOMALY_PLAN)).otherwise(_plan(REGULAR_PLAN))
    return numbered.select(*suppliers.columns, "supplier_index", F.inline(plan)).withColumn(
        "seed_key", F.concat_ws(":", "supplier_id", "doc_type", F.coalesce("anomaly", F.lit("ok"))))


def expand_all_types(suppliers: DataFrame) -> DataFrame:
    """Every supplier with every document type."""
    return suppliers.select("*", F.inline(_plan(
        [(t, None, degradation, severity) for t, (degradation, severity) in TYPE_DEGRADATION.items()])))

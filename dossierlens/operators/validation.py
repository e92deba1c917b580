"""Validation of whole tables: local rules plus cross-document consistency."""

from collections import namedtuple
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from dossierlens.operators import rules, siblings

# ``documents`` carry the nested validation; ``checks`` and ``anomalies`` are one row per finding; ``restated`` are the stored
# documents that conflict with a document of this run, with their new validation.
Validated = namedtuple("Validated", "documents checks anomalies restated")

# Wording.
MSG_SIBLINGS = "SIRET différent de %d document(s) du même fournisseur"


def stamp_anomalies(findings: DataFrame, as_of: datetime) -> DataFrame:
    """Give findings an id derived from their content, so that a replay produces the same rows. A document has one SIRET
    mismatch, whatever siblings it is found against, so a later run restates it under the same id."""
    of_content = F.col("type") != "SIRET_MISMATCH"
    return findings.select(
        F.sha2(F.concat_ws(
            "|", "document_id", "type", "severity", F.when(of_content, F.coalesce("related_document_id", F.lit(""))),
            F.when(of_content, F.col("message"))), 256).alias("anomaly_id"),
        "supplier_id", "document_id", "related_document_id", "type", "severity", "message", "details",
        F.lit(as_of).alias("detected_at"), F.lit(False).alias("resolved"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def mismatch_findings(found: DataFrame) -> DataFrame:
    return found.select(
        "supplier_id", "document_id", "related_document_id",
        F.lit("SIRET_MISMATCH").alias("type"), F.lit("error").alias("severity"),
        siblings.mismatch_message().alias("message"), siblings.mismatch_details().alias("details"))


def consistency_check(dtype=rules.CHECKS) -> Column:
    """The ``siret_consistency`` check of a document with ``n_mismatch`` differing siblings, as an array of at most one."""
    return rules.bag([(F.col("n_mismatch") > 0, rules.make_check(
        "siret_consistency", F.lit("error"), F.format_string(MSG_SIBLINGS, F.col("n_mismatch")),
        rules.details(current_siret=F.col("extracted.siret"), siblings=F.col("n_mismatch"))))], dtype)


def nested_validation(checks: Column, as_of: datetime) -> Column:
    return F.struct(
        rules.rollup_document_status(checks).alias("status"), checks.alias("checks"), F.lit(as_of).alias("validated_at"))


def restate(stored: DataFrame, found: DataFrame, as_of: datetime) -> DataFrame:
    """Stored documents that a document of this run conflicts with, under their new validation."""
    hit = found.where("not fresh").select("document_id", "n_mismatch")
    others = F.filter(F.col("validation.checks"), lambda c: c["rule"] != "siret_consistency")
    checked = stored.join(hit, "document_id").withColumn("_checks", F.concat(others, consistency_check()))
    return checked.withColumn("validation", nested_validation(F.col("_checks"), as_of)).select(*stored.columns)


def unnest(local: DataFrame, column: str, filled: str) -> DataFrame:
    """One row per array element. The outer form with a filter behind it is deliberate: for the inner form the optimizer
    adds a non-empty test on the array below the generator and would repeat the rules that build the array."""
    return local.select("document_id", "supplier_id", F.inline_outer(column)).where(F.col(filled).isNotNull())


def validate_documents(docs: DataFrame, as_of: datetime, stored: DataFrame = None, types: list = None,
                       work=None) -> Validated:
    """Validate every document against the rules of its type and against its siblings.

    A document that conflicts with siblings gets one check and one finding with their number and the smallest of their ids.
    ``stored`` are the documents of earlier runs: they count as siblings, and those that a document of this run conflicts
    with are found again and come back in ``restated`` (if they carry a ``validation``). ``types`` narrows the types that are
    compared. Documents that already carry the ``checks`` and ``findings`` of the local rules, typically a stage, are not
    judged again; if those are brief, so are the results, and the anomalies carry no id.
    """
    judged = {"checks", "findings"} <= set(docs.columns)
    local = docs if judged else rules.apply_local_rules(docs, as_of)
    types = siblings.TYPES_COMPARED if types is None else types
    rows = siblings.with_stored(docs, stored, types)
    conflicts = siblings.mismatches(rows, work)
    found = siblings.mismatching(rows, conflicts)

    own_siret = F.when(F.col("doc_type").isin(types), F.col("extracted.siret"))
    counts = conflicts.select("supplier_id", F.col("siret").alias("_siret_key"), "n_mismatch")
    counted = local.withColumn("_siret_key", own_siret).join(counts, ["supplier_id", "_siret_key"], "left")
    brief = "message" not in local.schema["checks"].dataType.elementType.names
    merged = counted.withColumn("checks", F.concat("checks", consistency_check(rules.BRIEF_CHECKS if brief else rules.CHECKS)))
    documents = merged.select(
        *[c for c in docs.columns if c not in ("validation", "status", "checks", "findings")],
        nested_validation(F.col("checks"), as_of).alias("validation"), F.lit("validated").alias("status"))

    mismatch_rows = mismatch_findings(found)
    own_checks, own_findings = unnest(local, "checks", "rule"), unnest(local, "findings", "type")
    checks = own_checks.unionByName(mismatch_rows.withColumns(
        {"rule": F.lit("siret_consistency"), "status": F.lit("error")}).select(*own_checks.columns))
    findings = own_findings.unionByName(mismatch_rows.select(*own_findings.columns))
    anomalies = findings.withColumn("resolved", F.lit(False)) if brief else stamp_anomalies(findings, as_of)
    restated = restate(stored, found, as_of) if stored is not None and "validation" in stored.columns else None
    return Validated(documents, checks, anomalies, restated)


def document_statuses(docs: DataFrame, as_of: datetime) -> DataFrame:
    return validate_documents(docs, as_of).documents.select(
        "document_id", F.col("validation.status").alias("validation_status"))

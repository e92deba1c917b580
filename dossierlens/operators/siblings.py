"""Cross-document SIRET consistency within a supplier.

A document conflicts with every stored document (sibling) of its supplier that shows another SIRET. Those pairs grow with the
square of a supplier, so they are never built. Instead:

1. documents are counted per (supplier, SIRET), combined before the shuffle and staged once;
2. suppliers with a single SIRET end there;
3. what a document needs to know about the others (how many, under how many SIRETs, the smallest id) is the total of its
   supplier less its own group, so it is the same for all documents of a (supplier, SIRET) and is computed once per group;
4. documents look their group up: one finding per document, however many siblings differ.

``sibling_pairs`` lists the siblings themselves, for documents that are asked for.
"""

from pyspark.sql import Column, DataFrame, functions as F

from dossierlens import schemas
from dossierlens.functions import identifiers
from dossierlens.storage import stage

# Wording and the types whose rules compare SIRETs.
MSG_MISMATCH = "Incohérence SIRET : %s (%s) ≠ %s (%s)"
TYPES_COMPARED = ["FACTURE", "URSSAF", "KBIS", "RIB", "SIRET"]

GROUP = ["supplier_id", "siret"]
PAIR_SALTS = 16


def comparable(docs: DataFrame, types: list = None, fresh: Column = None) -> DataFrame:
    """Documents with a SIRET, flagged by their role: ``compared`` documents get findings, ``sibling`` ones are seen. ``fresh``
    tells the documents of this run, by default all of them."""
    return docs.select(
        "document_id", "supplier_id", "original_filename", F.col("extracted.siret").alias("siret"),
        F.coalesce(F.col("doc_type").isin(TYPES_COMPARED if types is None else types), F.lit(False)).alias("compared"),
        F.coalesce(F.col("status").isin(schemas.SIBLING_STATUSES), F.lit(False)).alias("sibling"),
        (F.lit(True) if fresh is None else fresh).alias("fresh"),
    ).where(~identifiers.absent(F.col("siret")) & (F.col("compared") | F.col("sibling")))


def with_stored(docs: DataFrame, stored: DataFrame = None, types: list = None) -> DataFrame:
    """``comparable`` documents of this run together with those stored by earlier runs."""
    rows = comparable(docs, types)
    return rows if stored is None else rows.unionByName(comparable(stored, types, F.lit(False)))


def siret_counts(rows: DataFrame) -> DataFrame:
    """Per (supplier, SIRET): siblings, those of this run among them, and the sibling with the smallest id."""
    return rows.groupBy(*GROUP).agg(
        F.count_if("sibling").alias("n_siblings"), F.count_if(F.col("sibling") & F.col("fresh")).alias("n_fresh"),
        F.min(F.when(F.col("sibling"), F.struct("document_id", "original_filename"))).alias("first"))


def mismatches(rows: DataFrame, work=None) -> DataFrame:
    """What the documents of a (supplier, SIRET) conflict with, for the groups that conflict with anything: ``n_mismatch``
    siblings, ``n_fresh`` of them from this run, under ``n_other_sirets`` SIRETs, and ``related``, the one with the smallest id."""
    return stage(group_conflicts(stage(siret_counts(rows), "siret_groups", work)), "siret_mismatches", work)


def group_conflicts(groups: DataFrame) -> DataFrame:
    """``mismatches`` from counted groups; whole suppliers, of any number."""
    named = groups.withColumn("first", F.when(
        F.col("first").isNotNull(), F.struct("first.document_id", "first.original_filename", "siret")))
    totals = named.groupBy("supplier_id").agg(
        F.count("*").alias("groups"), F.count("first").alias("all_sirets"), F.sum("n_siblings").alias("all_siblings"),
        F.sum("n_fresh").alias("all_fresh"), F.min("first").alias("lowest"),
    ).where("groups > 1 and all_siblings > 0")
    joined = named.join(totals, "supplier_id")
    # A group that holds the smallest sibling of its supplier itself needs the smallest one of the other groups.
    second = joined.where(F.col("siret") != F.col("lowest.siret")).groupBy("supplier_id").agg(F.min("first").alias("second"))
    return joined.join(second, "supplier_id").select(
        *GROUP, (F.col("all_siblings") - F.col("n_siblings")).alias("n_mismatch"),
        (F.col("all_fresh") - F.col("n_fresh")).alias("n_fresh"),
        (F.col("all_sirets") - F.col("first").isNotNull().cast("long")).alias("n_other_sirets"),
        F.when(F.col("siret") == F.col("lowest.siret"), F.col("second")).otherwise(F.col("lowest")).alias("related"),
    ).where("n_mismatch > 0")


def mismatch_counts(docs: DataFrame, types: list = None) -> DataFrame:
    """Per (supplier, SIRET) the number of siblings with another SIRET, for the groups that have any."""
    return mismatches(comparable(docs, types)).select(*GROUP, "n_mismatch")


def mismatching(rows: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row per compared document of a conflicting group. Stored documents only appear when this run brought the conflict."""
    return (
        rows.where("compared").join(conflicts, GROUP).where("fresh or n_fresh > 0")
        .select("document_id", "supplier_id", "original_filename", "siret", "fresh", "n_mismatch", "n_other_sirets",
                F.col("related.document_id").alias("related_document_id"),
                F.col("related.original_filename").alias("related_filename"), F.col("related.siret").alias("related_siret")))


def sibling_siret_mismatch(docs: DataFrame, types: list = None, stored: DataFrame = None) -> DataFrame:
    """``document_id, supplier_id, original_filename, siret, fresh, n_mismatch, n_other_sirets, related_document_id,
    related_filename, related_siret``: one row per document that conflicts with a sibling."""
    rows = with_stored(docs, stored, types)
    return mismatching(rows, mismatches(rows))


def sibling_pairs(docs: DataFrame, for_documents: DataFrame, types: list = None, salts: int = PAIR_SALTS) -> DataFrame:
    """The differing siblings of the documents listed in ``for_documents`` (``document_id``), one row each.

    The documents of a supplier are dealt to ``salts`` parts and each asked document, of which there are few, looks into all of
    them, so a supplier with very many documents is not one task.
    """
    rows = comparable(docs, types)
    asking = rows.where("compared").join(for_documents.select("document_id"), "document_id", "left_semi").select(
        "document_id", "supplier_id", "siret").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    answering = rows.where("sibling").select(
        "supplier_id", F.col("document_id").alias("sibling_document_id"),
        F.col("original_filename").alias("sibling_filename"), F.col("siret").alias("sibling_siret"),
        F.pmod(F.xxhash64("document_id"), F.lit(salts)).cast("int").alias("_part"))
    return asking.join(answering, ["supplier_id", "_part"]).drop("_part").where(
        "siret <> sibling_siret and document_id <> sibling_document_id")


def mismatch_message() -> Column:
    return F.concat(
        F.format_string(MSG_MISMATCH, "original_filename", "siret", "related_filename", "related_siret"),
        F.when(F.col("n_mismatch") > 1, F.format_string(" [%d]", "n_mismatch")).otherwise(F.lit("")))


def mismatch_details() -> Column:
    return F.create_map(
        F.lit("current_siret"), F.col("siret"), F.lit("sibling_siret"), F.col("related_siret"),
        F.lit("sibling_document_id"), F.col("related_document_id"),
        F.lit("sibling_filename"), F.col("related_filename"),
        F.lit("siblings"), F.col("n_mismatch").cast("string"), F.lit("other_sirets"), F.col("n_other_sirets").cast("string"))

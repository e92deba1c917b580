"""Filters, list projections, top-k pages and input checks.

Every function is a lazy ``where``/``select``/``orderBy`` over columns, so predicates and column lists reach the scan.
Limits are optional: they exist where a page or a top-k is what the caller asks for.
"""

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from dossierlens import schemas
from dossierlens.functions import text as tx

NAME_MAX_CHARS = 200
EMAIL_PATTERN = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"


def _equalities(df: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def filter_documents(df, supplier_id=None, doc_type=None, status=None) -> DataFrame:
    return _equalities(df, supplier_id=supplier_id, doc_type=doc_type, status=status)


def filter_anomalies(df, supplier_id=None, severity=None, type=None, resolved=None) -> DataFrame:
    return _equalities(df, supplier_id=supplier_id, severity=severity, type=type, resolved=resolved)


def search_suppliers(df, search=None, compliance_status=None) -> DataFrame:
    """Regular expression on the name, ignoring case, or on the SIRET."""
    if search:
        df = df.where(F.col("name").rlike("(?i)" + search) | F.col("siret").rlike(search))
    return _equalities(df, compliance_status=compliance_status)


def search_suppliers_literal(df, search=None, compliance_status=None) -> DataFrame:
    if search:
        df = df.where(
            F.contains(F.lower("name"), F.lit(search.lower())) | F.contains(F.col("siret"), F.lit(search)))
    return _equalities(df, compliance_status=compliance_status)


def filter_filename(df, search) -> DataFrame:
    return df.where(F.contains(F.lower("original_filename"), F.lit(search.lower()))) if search else df


def get_by_id(df, key, value) -> DataFrame:
    return df.where(F.col(key) == value)


def status_in(df, statuses, negate=False) -> DataFrame:
    condition = F.col("status").isin(statuses)
    return df.where(~condition if negate else condition)


def list_projection(df) -> DataFrame:
    """Columns of the list view. The text column is never read, and only one field of the nested validation is."""
    return df.select(
        "document_id", "supplier_id", "original_filename", "doc_type", "status", "upload_timestamp",
        "classification_confidence", F.col("validation.status").alias("validation_status"))


def document_view(df) -> DataFrame:
    return df.select(
        "document_id", "supplier_id", "filename", "original_filename", "mime_type", "file_size_bytes",
        "upload_timestamp", "status", F.coalesce("zone", F.lit("raw")).alias("zone"), "doc_type",
        "classification_confidence", "ocr_quality_score",
        F.when(F.col("extracted").isNotNull(), F.struct(
            *[F.col("extracted")[name].alias(name) for name in schemas.EXTRACTED_FIELDS])).alias("extracted"),
        F.when(F.col("validation").isNotNull(), F.struct(
            F.coalesce("validation.status", F.lit("pending")).alias("status"),
            F.coalesce("validation.checks", F.array().cast(schemas.VALIDATION["checks"].dataType)).alias("checks"),
        )).alias("validation"),
        "processing_duration_ms", "error_message")


def supplier_problems(df) -> DataFrame:
    """Add ``problems``, the rules a supplier row breaks, and the derived ``siren`` and initial status."""
    name, siret, siren, email = (F.col(c) for c in ("name", "siret", "siren", "email"))
    rules = {
        "name": ~F.coalesce(F.length(name).between(1, NAME_MAX_CHARS), F.lit(False)),
        "siret": F.coalesce(~siret.rlike("^[0-9]{14}$"), F.lit(False)),
        "siren": F.coalesce(~siren.rlike("^[0-9]{9}$"), F.lit(False)),
        "email": F.coalesce(~email.rlike(EMAIL_PATTERN), F.lit(False)),
    }
    none = F.array().cast("array<string>")
    problems = F.concat(*[F.when(bad, F.array(F.lit(field))).otherwise(none) for field, bad in rules.items()])
    return df.withColumns({
        "problems": problems,
        "siren": F.coalesce(F.nullif(siren, F.lit("")), F.substring(siret, 1, 9)),
        "compliance_status": F.lit("pending"),
    })


def validate_supplier_input(df):
    """``(accepted, rejected)``; rejected rows keep the list of their problems."""
    judged = supplier_problems(df)
    return judged.where(F.size("problems") == 0).drop("problems"), judged.where(F.size("problems") > 0)


def _tie(df: DataFrame, columns: list):
    """Text that orders rows which nothing else does: equal texts mean equal values."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("")


def reduce_patches(patch: DataFrame, key: str, order: list = ()) -> DataFrame:
    """One row per key: for every field the last value that is not null, in the order of the columns ``order``.

    Patches of one place in the order, or without any, are settled by their values (the greatest JSON text), so the result never
    depends on how rows arrive. The order columns are not part of the result.
    """
    fields = [c for c in patch.columns if c != key and c not in order]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, _tie(patch, [c]).alias("_tie")))).alias(c) for c in fields]
    return patch.groupBy(key).agg(*last) if last else patch.select(key).distinct()


def sparse_update(df: DataFrame, patch: DataFrame, key: str, as_of: datetime = None, order: list = ()) -> DataFrame:
    """Overwrite columns with the non-null values of the patch rows of a key; of several the last one counts, field by field
    (``reduce_patches``). Rows of ``df`` are never multiplied."""
    patch = reduce_patches(patch, key, order)
    fields = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = df.join(renamed, key, "left")
    changed = F.lit(False)
    for c in fields:
        changed = changed | F.col(f"_{c}").isNotNull()

    def value(c):
        if c in fields:
            return F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
        if c == "updated_at" and as_of is not None:
            return F.when(changed, F.lit(as_of)).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return joined.select(*[value(c) for c in df.columns])


def usable(df, text_col="text", confidence_col="confidence") -> DataFrame:
    return df.where(tx.is_usable(F.col(text_col), F.col(confidence_col)))


def split_resolved(df):
    return df.where(~F.col("resolved")), df.where("resolved")


def expiration_anomalies(df, limit=None) -> DataFrame:
    """Open expiry findings, newest first."""
    found = df.where(F.col("type").isin(schemas.EXPIRY_TYPES) & ~F.col("resolved")).orderBy(
        F.desc("detected_at"), "anomaly_id")
    return found if limit is None else found.limit(limit)


def _page(df, newest, key, skip, limit, after) -> DataFrame:
    """A page in order of ``newest`` (descending, if given) and ``key``.

    ``after`` is the last row of the page before: its (time, key), or its key where there is no time. The page then is a top-k over
    the rows behind that place, a filter that reaches the files' statistics, however far the page is: a task keeps ``limit`` rows.
    ``skip`` counts from the start instead, which makes every task keep ``skip + limit`` rows.
    """
    if after is not None:
        if newest is None:
            df = df.where(F.col(key) > after)
        else:
            time, last = after
            # The first condition follows from the second; alone it can be compared with the range of a row group.
            df = df.where(F.col(newest) <= F.lit(time)).where((F.col(newest) < F.lit(time)) | (F.col(key) > last))
    order = [key] if newest is None else [F.desc(newest), key]
    return (df.orderBy(*order).offset(skip) if skip else df.orderBy(*order)).limit(limit)


def page_documents(df, skip=0, limit=50, after=None) -> DataFrame:
    """``after``: (upload_timestamp, document_id) of the last document of the page before."""
    return _page(df, "upload_timestamp", "document_id", skip, limit, after)


def page_anomalies(df, skip=0, limit=100, after=None) -> DataFrame:
    """``after``: (detected_at, anomaly_id) of the last finding of the page before."""
    return _page(df, "detected_at", "anomaly_id", skip, limit, after)


def page_suppliers(df, skip=0, limit=50, after=None) -> DataFrame:
    """``after``: supplier_id of the last supplier of the page before."""
    return _page(df, None, "supplier_id", skip, limit, after)


def recent(df, n=8, time_col="upload_timestamp", key="document_id") -> DataFrame:
    return df.orderBy(F.desc(time_col), key).limit(n)


def next_document(docs) -> DataFrame:
    """Newest pending document, otherwise the newest of any status: one ordered take, not two queries."""
    return docs.orderBy(F.desc(F.col("status") == "pending"), F.desc("upload_timestamp"), "document_id").limit(1)


def latest_n_per_supplier(docs, n=5) -> DataFrame:
    """Newest processed and typed documents per supplier.

    Spark cuts each group to ``n`` rows before the shuffle because the rank is filtered, so a supplier that holds a large
    share of the table sends only ``n`` rows per task.
    """
    newest = Window.partitionBy("supplier_id").orderBy(F.desc("upload_timestamp"), "document_id")
    return docs.where((F.col("status") == "processed") & F.col("doc_type").isNotNull()).withColumn(
        "recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def reset_status(docs, ids: DataFrame = None) -> DataFrame:
    """Back to ``pending`` for all documents or for those listed in ``ids``."""
    error = F.lit(None).cast("string")
    if ids is None:
        return docs.withColumns({"status": F.lit("pending"), "error_message": error})
    listed = ids.select("document_id").distinct().withColumn("_listed", F.lit(True))
    joined = docs.join(listed, "document_id", "left")
    hit = F.col("_listed").isNotNull()
    return joined.withColumns({
        "status": F.when(hit, F.lit("pending")).otherwise(F.col("status")),
        "error_message": F.when(hit, error).otherwise(F.col("error_message")),
    }).select(*docs.columns)

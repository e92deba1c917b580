"""Queries that run a stream to its end and read the result."""

import math

from pyspark.sql import functions as F

from dossierlens.catalog import bindings as b
from dossierlens.catalog.reference_sql import ANO, DOC, EVT, MISMATCH, READ_BACK, sql
from dossierlens.catalog.registry import query
from dossierlens.catalog.understanding import rendered
from dossierlens.storage import scratch_path
from dossierlens.streaming import jobs


# Rows of a landed file, files of a micro-batch at least, and micro-batches at most: every batch has costs of its own (state, ledger,
# jobs, what tasks report to the driver), so a longer backlog is taken in larger batches, not in more.
FILE_ROWS, BATCH_FILES, BATCHES = 10_000, 4, 16


def _landing(df, spark, name):
    """Write the rows as files cut by size, as the tasks have them, of which the stream takes several per micro-batch."""
    path = scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return jobs.file_stream(spark, path, df.schema, max_files=max(BATCH_FILES, math.ceil(files / BATCHES)))


def _events(spark, sf_dir):
    return jobs.file_stream(spark, sf_dir, b.table(spark, sf_dir, "events").schema, "events.parquet")


def _run(stream, spark, name, mode):
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    jobs.write_batches(stream, path, checkpoint, mode).awaitTermination()
    return path


@query("t01_stream_understanding", sql(READ_BACK, "SELECT document_id, doc_type, siret, montant_ttc FROM doc"))
def stream_understanding(spark, sf_dir):
    path, errors = scratch_path(spark, "understood"), scratch_path(spark, "errors")
    stream = _landing(rendered(spark, sf_dir), spark, "incoming")
    jobs.stream_understanding(stream, path, errors, scratch_path(spark, "understood-checkpoint")).awaitTermination()
    return spark.read.option("basePath", path).parquet(path).select(
        "document_id", "doc_type", "extracted.siret", "extracted.montant_ttc")


@query("t02_stream_compliance", sql(ANO, """
    SELECT supplier_id, cast(count(CASE WHEN NOT resolved THEN 1 END) AS bigint) AS unresolved,
      cast(count(CASE WHEN NOT resolved AND severity = 'error' THEN 1 END) AS bigint) AS critical,
      CASE WHEN count(CASE WHEN NOT resolved AND severity = 'error' THEN 1 END) > 0 THEN 'non_compliant'
        WHEN count(CASE WHEN NOT resolved THEN 1 END) > 0 THEN 'warning' ELSE 'compliant' END AS compliance_status
    FROM ano GROUP BY supplier_id"""))
def stream_compliance(spark, sf_dir):
    stream = _landing(b.anomalies(spark, sf_dir), spark, "findings")
    path = _run(jobs.stream_compliance(stream), spark, "compliance", "update")
    return jobs.snapshot(spark, path, ["supplier_id"])


@query("t03_stream_dashboard", sql(DOC, "SELECT status, cast(count(*) AS bigint) AS n FROM doc GROUP BY status"))
def stream_dashboard(spark, sf_dir):
    stream = _landing(b.documents(spark, sf_dir).select("document_id", "status"), spark, "statuses")
    return jobs.snapshot(spark, _run(jobs.stream_dashboard(stream), spark, "dashboard", "update"), ["status"])


@query("t04_stream_dedupe", sql(EVT, "SELECT DISTINCT document_id FROM evt"))
def stream_dedupe(spark, sf_dir):
    """Repeats within a week are dropped by the stream, whose state is a week's ids; one that comes later is the same document
    again, which the reader's snapshot settles."""
    docs = b.status_events(_events(spark, sf_dir)).withColumnRenamed("ts", "upload_timestamp")
    path = _run(jobs.stream_dedupe(docs, "7 days"), spark, "deduped", "append")
    return jobs.snapshot(spark, path, ["document_id"]).select("document_id")


@query("t05_stream_sibling_check", sql(DOC, MISMATCH, """
    SELECT document_id, related_document_id, n_mismatch FROM mis"""))
def stream_sibling_check(spark, sf_dir):
    silver, conflicts = scratch_path(spark, "silver"), scratch_path(spark, "sibling-conflicts")
    docs = b.documents(spark, sf_dir).select(
        "document_id", "supplier_id", "original_filename", "doc_type", "status", "extracted")
    stream = _landing(docs, spark, "sibling-input")
    jobs.stream_sibling_check(
        stream, silver, conflicts, scratch_path(spark, "sibling-ledger"), scratch_path(spark, "sibling-checkpoint")).awaitTermination()
    return jobs.sibling_findings(spark, silver, conflicts, b.AS_OF).select(
        "document_id", "related_document_id", F.col("details")["siblings"].cast("bigint").alias("n_mismatch"))


@query("t07_stream_status_latest", sql(EVT, """
    SELECT document_id, arg_max(status, (ts, event_id)) AS status FROM evt GROUP BY document_id"""))
def stream_status_latest(spark, sf_dir):
    stream = _landing(b.status_events(b.table(spark, sf_dir, "events")), spark, "status-events")
    return jobs.snapshot(spark, _run(jobs.stream_status_latest(stream), spark, "latest", "update"), ["document_id"])

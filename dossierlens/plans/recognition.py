"""From raw files to recognised text: one result per document, whatever the file is.

The files are scanned once. Each is routed by its type, and text files are decoded in that scan, so ``content`` is read a single
time and goes no further; what follows works on ids, routes and decoded text. Three branches give the same columns:

* text files: the decoded text;
* PDF files with enough embedded text: that text (``native_text``, as a PDF reader delivers it);
* all others, unknown types included: the words of a recognition engine (``words``, several passes per page) become lines, the
  best pass of a page is kept, pages of a fallback engine replace uncertain ones, and pages become a document.

The words are shuffled once, by document: lines, passes, pages and documents are all groups within that partitioning. Files for
which a branch has nothing come out with method ``failed`` and empty text, so no file is lost. Recognition engines and PDF readers
are not part of this library; their output is an input table.
"""

from collections import namedtuple
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from dossierlens.functions import text as tx
from dossierlens.operators import ocr
from dossierlens.plans.processing import process_documents
from dossierlens.storage import stage

RESULT = ["document_id", "text", "confidence", "method", "ocr_config", "page_count", "word_count", "preprocessing_strategy"]
# Fixed value: the fallback engine is only asked below this confidence, which switches it off by default.
FALLBACK_THRESHOLD = 0.0

Recognised = namedtuple("Recognised", "results processed")


def engine_config(pass_no: Column) -> Column:
    """Setting of the recognition engine in each pass; later passes than there are settings repeat the last one."""
    return F.get(F.array(*[F.lit(c) for c in ocr.OCR_CONFIGS]), F.least(pass_no, F.lit(len(ocr.OCR_CONFIGS) - 1)).cast("int"))


def recognise_pages(words: DataFrame, candidates: DataFrame = None, fallback: DataFrame = None,
                    threshold: float = FALLBACK_THRESHOLD) -> DataFrame:
    """One row per page: text, confidence, ocr_config, preprocessing_strategy.

    ``candidates``: scored preprocessing tries per page (strategy, try_order, score). ``fallback``: text and confidence per page.
    """
    passes = ocr.reconstruct_lines(words, by=["document_id"]).withColumn("ocr_config", engine_config(F.col("pass_no")))
    pages = ocr.best_ocr_pass(passes).select("document_id", "page", "text", "confidence", "ocr_config")
    if candidates is None:
        pages = pages.withColumn("preprocessing_strategy", F.lit(None).cast("string"))
    else:
        best = ocr.best_preprocessing_candidate(candidates).select("document_id", "page", F.col("strategy").alias("preprocessing_strategy"))
        pages = pages.join(best, ["document_id", "page"], "left")
    return pages if fallback is None else ocr.prefer_fallback(pages, fallback, threshold)


def _failed() -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(F.lit("").alias("text"), F.lit(0.0).alias("confidence"), F.lit("failed").alias("method"), nothing.alias("ocr_config"),
                    F.lit(0).alias("page_count"), F.lit(0).alias("word_count"), nothing.alias("preprocessing_strategy"))


def recognise(files: DataFrame, native_text: DataFrame = None, pages: DataFrame = None, work=None) -> DataFrame:
    """``document_id`` and the recognition result of every row of ``files`` (document_id, mime_type, content).

    ``native_text``: document_id, text embedded in a PDF. ``pages``: what ``recognise_pages`` returns. Both may lack documents; ids
    are unique in files and in native_text.
    """
    route = ocr.route_by_mime(F.coalesce("mime_type", F.lit("")))
    decoded = tx.clean_ocr_text(F.make_valid_utf8(F.col("content").cast("string")))
    read = stage(files.select("document_id", route.alias("route"), F.when(route == "text", decoded).alias("text")), "read_files", work)
    missing = F.lit(None).cast("string")
    plain = read.where("route = 'text'").select(
        "document_id", "text", F.lit(1.0).alias("confidence"), F.lit("plain_text").alias("method"), missing.alias("ocr_config"),
        F.lit(1).alias("page_count"), tx.word_count(F.col("text")).alias("word_count"), missing.alias("preprocessing_strategy"))
    fields = RESULT[1:]
    scanned = read.where("route <> 'text'").select("document_id", "route")
    choices = []
    if native_text is not None:
        embedded = native_text.select("document_id", ocr.native_text_result(F.col("text")).alias("native"))
        scanned = scanned.join(embedded, "document_id", "left")
        choices.append(F.when(F.col("route") == "pdf", F.col("native")))
    if pages is not None:
        merged = ocr.merge_pages(pages)
        scanned = scanned.join(merged.select("document_id", F.struct(*[
            F.col(c).cast("int").alias(c) if c == "page_count" else F.col(c) for c in fields]).alias("read")), "document_id", "left")
        choices.append(F.col("read"))
    found = scanned.select("document_id", F.coalesce(*choices, _failed()).alias("r")).select("document_id", *[f"r.{c}" for c in fields])
    return plain.unionByName(found)


def recognised_documents(records: DataFrame, results: DataFrame) -> DataFrame:
    """The uploaded records with text and quality of their recognition, as the chain expects them; the status says how far they are."""
    kept = [c for c in records.columns if c not in ("ocr_text", "ocr_quality_score", "status", "zone")]
    read = results.select("document_id", F.col("text").alias("ocr_text"), F.col("confidence").alias("ocr_quality_score"))
    return records.select(*kept).join(read, "document_id").withColumns({"status": F.lit("ocr_done"), "zone": F.lit("clean")})


def process_files(files: DataFrame, records: DataFrame, suppliers: DataFrame, as_of: datetime, native_text: DataFrame = None,
                  pages: DataFrame = None, work=None, **options) -> Recognised:
    """Raw files to findings: recognition, then the whole chain over the recognised records."""
    results = stage(recognise(files, native_text, pages, work), "recognised", work)
    return Recognised(results, process_documents(recognised_documents(records, results), suppliers, as_of, work=work, **options))

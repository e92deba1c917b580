"""Recognition results as tables: words to lines, lines to pages, pages to documents, choice of passes and strategies.

The values gathered per group (words of a line, lines of a page, pages of a document) are exactly the text of one result
row, so no task holds more than the row it writes.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossierlens.functions import text as tx

# Thresholds, separators and strategy names.
MIN_WORD_CONFIDENCE = 40
EARLY_STOP_CONFIDENCE = 0.65
FULL_LENGTH_CHARS = 500
PAGE_SEPARATOR = "\n\n--- PAGE SUIVANTE ---\n\n"
MAX_RAW_BYTES = 50 * 1024 * 1024
OCR_CONFIGS = [
    "--oem 3 --psm 3 -l fra+eng", "--oem 3 --psm 6 -l fra+eng", "--oem 3 --psm 4 -l fra+eng",
    "--oem 3 --psm 11 -l fra+eng",
]
IMAGE_MIMES = ["image/jpeg", "image/png", "image/tiff", "image/bmp", "image/webp"]


def reconstruct_lines(words: DataFrame, min_conf: float = MIN_WORD_CONFIDENCE, by: list = None) -> DataFrame:
    """One row per ``document_id, page, pass_no``: text with its line structure and mean confidence of the kept words.

    Words are shuffled once: lines and pages are both groups within the partitioning by page, or by the keys ``by`` that a caller
    goes on grouping by. Words do not combine before the shuffle, as every one of them is part of the text.
    """
    page_keys = ["document_id", "page", "pass_no"]
    words = words.repartition(*(by or page_keys))
    line_keys = ["block_num", "par_num", "line_num"]
    word = tx.strip(F.col("text"))
    kept = (F.col("conf") >= min_conf) & (word != "")
    lines = words.groupBy(*page_keys, *line_keys).agg(
        F.collect_list(F.when(kept, F.struct("word_num", word.alias("text")))).alias("_words"),
        F.sum(F.when(kept, F.col("conf"))).alias("_conf"),
        F.count_if(kept).alias("_n"),
    )
    line_text = F.array_join(F.array_sort("_words")["text"], " ")
    filled = F.when(F.col("_n") > 0, F.struct(*line_keys, line_text.alias("line")))
    pages = lines.groupBy(*page_keys).agg(
        F.collect_list(filled).alias("_lines"), F.sum("_conf").alias("_conf"), F.sum("_n").alias("_n"))
    return pages.select(
        *page_keys,
        tx.strip(F.array_join(F.array_sort("_lines")["line"], "\n")).alias("text"),
        F.coalesce(F.try_divide("_conf", "_n") / 100, F.lit(0.0)).alias("confidence"),
    )


def best_ocr_pass(passes: DataFrame, early_stop: float = EARLY_STOP_CONFIDENCE) -> DataFrame:
    """The pass a sequential trial would keep.

    Passes run in order and a pass becomes the best one when it beats every earlier score. The trial stops at the first
    best pass that is confident enough, hence the answer is that pass, or else the last pass that became the best.
    """
    page = Window.partitionBy("document_id", "page")
    earlier = page.orderBy("pass_no").rowsBetween(Window.unboundedPreceding, -1)
    score = F.col("confidence") * F.least(F.length("text") / F.lit(float(FULL_LENGTH_CHARS)), F.lit(1.0))
    record = F.col("_score") > F.coalesce(F.max("_score").over(earlier), F.lit(0.0))
    marked = passes.withColumn("_score", score).withColumn("_record", record)
    winner = F.coalesce(
        F.min(F.when(F.col("_record") & (F.col("confidence") >= early_stop), F.col("pass_no"))).over(page),
        F.max(F.when(F.col("_record"), F.col("pass_no"))).over(page),
    )
    chosen = marked.withColumns({"_winner": winner, "_first": F.min("pass_no").over(page)}).where(
        F.col("pass_no") == F.coalesce(F.col("_winner"), F.col("_first")))
    found = F.col("_winner").isNotNull()
    return chosen.withColumns({
        "text": F.when(found, F.col("text")).otherwise(F.lit("")),
        "confidence": F.when(found, F.col("confidence")).otherwise(F.lit(0.0)),
    }).drop("_score", "_record", "_winner", "_first")


def merge_pages(pages: DataFrame) -> DataFrame:
    """One row per document from ``page, text, confidence, ocr_config, preprocessing_strategy``. ``word_count`` counts the words of the
    cleaned text, ``read_words`` those of the pages as read, page marks and dropped lines included."""
    joined = pages.groupBy("document_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("page", "text")))["text"], PAGE_SEPARATOR).alias("_text"),
        F.avg("confidence").alias("confidence"),
        F.count("*").alias("page_count"),
        F.max_by("ocr_config", "page").alias("ocr_config"),
        F.max_by("preprocessing_strategy", "page").alias("preprocessing_strategy"),
    )
    method = (
        F.when(F.col("preprocessing_strategy") == "trocr", F.lit("trocr"))
        .when(F.col("page_count") > 1, F.lit("tesseract_multi"))
        .otherwise(F.lit("tesseract"))
    )
    return joined.withColumn("text", tx.clean_ocr_text(F.col("_text"))).select(
        "document_id", "text", "confidence", method.alias("method"), "ocr_config", "page_count",
        tx.word_count(F.col("text")).alias("word_count"), "preprocessing_strategy",
        tx.word_count(F.col("_text")).alias("read_words"))


def prefer_fallback(primary: DataFrame, fallback: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Take the fallback engine's page where the primary confidence is below the threshold and the fallback is higher."""
    other = fallback.select(
        "document_id", "page", F.col("text").alias("_text"), F.col("confidence").alias("_confidence"))
    use = F.coalesce(
        (F.col("confidence") < threshold) & (F.col("_confidence") > F.col("confidence")), F.lit(False))
    return primary.join(other, ["document_id", "page"], "left").select(
        "document_id", "page",
        F.when(use, F.col("_text")).otherwise(F.col("text")).alias("text"),
        F.when(use, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(~use, F.col("ocr_config")).alias("ocr_config"),
        F.when(use, F.lit("trocr")).otherwise(F.col("preprocessing_strategy")).alias("preprocessing_strategy"),
    )


def route_by_mime(mime: Column) -> Column:
    kind = F.lower(F.trim(mime))
    return (
        F.when(kind == "application/pdf", F.lit("pdf"))
        .when(kind.isin(IMAGE_MIMES), F.lit("image"))
        .when(kind.startswith("text/"), F.lit("text"))
        .otherwise(F.lit("image"))
    )


def native_text_result(text: Column) -> Column:
    """Result struct of text that was embedded in the file; NULL when there is too little of it."""
    cleaned = tx.clean_ocr_text(text)
    return F.when(tx.is_native_text(text), F.struct(
        cleaned.alias("text"), F.lit(0.98).alias("confidence"), F.lit("native_pdf").alias("method"),
        F.lit(None).cast("string").alias("ocr_config"), tx.page_count(text).alias("page_count"),
        tx.word_count(cleaned).alias("word_count"), F.lit(None).cast("string").alias("preprocessing_strategy")))


def quality_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_blurry": F.col("blur_score") < 80,
        "is_very_blurry": F.col("blur_score") < 30,
        "is_low_contrast": F.col("contrast_score") < 40,
        "is_dark": F.col("brightness") < 80,
        "is_overexposed": F.col("brightness") > 210,
        "is_skewed": F.abs("skew_angle") > 0.5,
        "is_noisy": F.col("noise_score") > 15,
        "needs_upscale": (F.col("width") < 1000) | (F.col("height") < 1000),
    })


def candidate_strategies(df: DataFrame) -> DataFrame:
    """Add the ordered list of preprocessing strategies worth trying for a page."""
    flagged = quality_flags(df)

    def optional(flag, *names):
        return F.when(F.col(flag), F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))

    blurry = F.when(F.col("is_very_blurry"), F.array(F.lit("very_blurry"), F.lit("blurry"))).otherwise(
        optional("is_blurry", "blurry"))
    return flagged.withColumn("strategies", tx.dedupe_keep_order(F.concat(
        optional("is_noisy", "noisy"), optional("is_low_contrast", "low_contrast"),
        optional("is_overexposed", "overexposed"), optional("is_dark", "dark_scan"), blurry,
        F.array(F.lit("standard"), F.lit("adaptive_standard")))))


def readability_score(sharpness: Column, black_ratio: Column) -> Column:
    return sharpness + F.when(black_ratio.between(0.05, 0.40), F.lit(100.0)).otherwise(F.lit(0.0))


def best_preprocessing_candidate(candidates: DataFrame) -> DataFrame:
    """Highest score per page, the earlier try on ties; an aggregate that combines before the shuffle, not a window."""
    order = F.when(F.col("score") > -1.0, F.struct(F.col("score"), -F.col("try_order")))
    best = candidates.groupBy("document_id", "page").agg(
        F.max_by(F.col("strategy"), order).alias("strategy"), F.max(order)["score"].alias("score"))
    return best.withColumn("strategy", F.coalesce("strategy", F.lit("standard_fallback")))

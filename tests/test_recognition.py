"""The recognition plan on hand-made files, and what it reads."""

from datetime import datetime

from dossierlens.plans import recognition
from dossierlens.storage import WorkFolder

FILES = [("t", "text/plain", "Facture 0RACLE\n--\nTotal 12 €".encode()), ("latin", "text/csv", "café".encode("latin-1")), ("empty", "text/plain", b""),
         ("native", "application/pdf", b"%PDF"), ("short", "application/pdf", b"%PDF"), ("scan", " IMAGE/PNG", b"\x89"), ("odd", None, b"?"), ("none", "image/bmp", None)]
WORDS = [("scan", 1, 0, 1, 1, 1, 1, "Bonjour", 90.0), ("scan", 1, 0, 1, 1, 1, 2, "monde", 80.0), ("scan", 2, 0, 1, 1, 1, 1, "flou", 41.0),
         ("scan", 2, 1, 1, 1, 1, 1, "net", 95.0), ("short", 1, 0, 1, 1, 1, 1, "x", 10.0), ("native", 1, 0, 1, 1, 1, 1, "ignored", 99.0),
         ("odd", 1, 0, 1, 1, 1, 1, "inconnu", 70.0)]


def inputs(spark):
    files = spark.createDataFrame(FILES, "document_id string, mime_type string, content binary")
    native = spark.createDataFrame([("native", "mot " * 20 + "\n\n" + "suite"), ("short", "trop court"), ("t", "not a pdf " * 9)], "document_id string, text string")
    words = spark.createDataFrame(WORDS, "document_id string, page int, pass_no int, block_num int, par_num int, line_num int, word_num int, text string, conf double")
    fallback = spark.createDataFrame([("scan", 2, "repli", 0.6), ("short", 1, "lu quand même", 0.6)], "document_id string, page int, text string, confidence double")
    return files, native, recognition.recognise_pages(words, fallback=fallback, threshold=0.5)


def test_every_file_has_one_result(spark):
    with WorkFolder(spark) as work:
        rows = {r.document_id: r for r in recognition.recognise(*inputs(spark), work=work).collect()}
    assert len(rows) == len(FILES)
    short = {k: (r.text, r.method, r.page_count, r.word_count) for k, r in rows.items()}
    assert short["t"] == ("Facture ORACLE\nTotal 12 €", "plain_text", 1, 5) and short["latin"][1] == "plain_text"
    assert short["empty"] == ("", "plain_text", 1, 0) and short["none"] == ("", "failed", 0, 0)
    assert short["native"][1:] == ("native_pdf", 2, 21) and rows["native"].confidence == 0.98
    assert short["scan"] == ("Bonjour monde\n--- PAGE SUIVANTE ---\nnet", "tesseract_multi", 2, 7)
    assert rows["scan"].ocr_config.startswith("--oem 3 --psm 6") and abs(rows["scan"].confidence - 0.9) < 1e-9
    assert short["short"] == ("lu quand même", "trocr", 1, 3) and rows["short"].ocr_config is None
    assert short["odd"][:2] == ("inconnu", "tesseract")


def test_content_is_read_once_and_words_shuffled_once(spark):
    files, native, pages = inputs(spark)
    plan = recognition.recognise(files, native, pages)._jdf.queryExecution()
    assert "content" not in plan.optimizedPlan().toString()  # the stage has the decoded text, not the bytes
    merged = recognition.ocr.merge_pages(recognition.ocr.best_ocr_pass(recognition.ocr.reconstruct_lines(
        spark.createDataFrame(WORDS, "document_id string, page int, pass_no int, block_num int, par_num int, line_num int, word_num int, text string, conf double"),
        by=["document_id"]).selectExpr("*", "'c' as ocr_config", "'s' as preprocessing_strategy")))
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_files_to_findings(spark):
    files, native, pages = inputs(spark)
    records = files.selectExpr("document_id", "'s' as supplier_id", "concat(document_id, '.bin') as original_filename", "'pending' as status")
    suppliers = spark.createDataFrame([("s", "S", "pending")], "supplier_id string, name string, compliance_status string")
    with WorkFolder(spark) as work:
        done = recognition.process_files(files, records, suppliers, datetime(2026, 1, 1, 9), native, pages, work=work)
        assert {r.document_id for r in done.processed.failed.collect()} == {"empty", "none"}
        assert {r.document_id: r.status for r in done.processed.documents.collect()} == dict.fromkeys(["t", "latin", "native", "short", "scan", "odd"], "processed")

"""Plans and inputs on which a registered query once ended by its time or memory before its work was done."""

import random
from threading import Barrier

from pyspark.sql import functions as F

import compare
from dossierlens.catalog import CHECKS, QUERIES, recognition, understanding
from dossierlens.functions import text
from dossierlens.llm import nearest
from dossierlens.operators import training
from dossierlens.sources import readers

SF_DIR = "/root/testdata/sf0.001"


def test_nearest_passes_no_table_through_the_driver(spark, monkeypatch):
    """Tables just below the broadcast limit filled the driver's memory; what is small here is as large as the input elsewhere."""
    plans, stage = {}, nearest.stage
    monkeypatch.setattr(nearest, "stage", lambda df, name: plans.update({name: df}) or stage(df, name))
    found = nearest.op6_nearest(spark, SF_DIR)
    assert {"queries", "found"} <= set(plans)
    for df in (*plans.values(), found):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_raw_files_share_folders(spark, tmp_path, monkeypatch):
    """A folder per file was made, listed and kept by the driver."""
    monkeypatch.setattr(recognition, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = [(i, None if i % 7 == 0 else f"é {i}\nfin" * (i % 5)) for i in range(2 * recognition.FOLDER_IDS)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got = {r.document_id: bytes(r.content).decode() for r in recognition.text_files(spark, str(tmp_path)).collect()}
    assert got == {f"doc-{i}": (text or "") + "\n" for i, text in rows}
    assert len(list(tmp_path.glob("raw/doc_id=*"))) == 2


def test_files_of_other_stores_are_read_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recognition, "_local", lambda path: None)
    for name in ("s01_read_raw", "s02_decode_text"):
        assert compare.differences(spark, compare.connection(SF_DIR), SF_DIR, QUERIES[name], CHECKS[name]) == ""


def test_local_paths():
    assert [recognition._local(p) for p in ("/a/b", "file:/a/b", "file:///a/b", "hdfs://h/a", "viewfs:///a", "file://h/a")] == [
        "/a/b", "/a/b", "/a/b", None, None, None]


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    """Every folder was listed by a task of its own."""
    folders = 3 * readers.LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for i in range(folders):
        (tmp_path / f"zone/{i}").mkdir(parents=True)
        (tmp_path / f"zone/{i}/a.txt").write_text(str(i))
    kept, context = spark.conf.get(readers.LISTING_TASKS), spark.sparkContext
    context.setJobGroup("listing", "")
    try:
        accepted, _ = readers.read_raw(spark, str(tmp_path / "zone"), accepted=["text/plain"])
        tracker = context.statusTracker()
        tasks = [tracker.getStageInfo(s).numTasks for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= folders / 3
    assert accepted.count() == folders and spark.conf.get(readers.LISTING_TASKS) == kept


def test_folds_are_fitted_at_once(spark, monkeypatch):
    """One fold after the other left the cores idle that its fit could not use."""
    both = Barrier(2, timeout=60)

    class Echo:
        def predict(self, df, text_col):
            return df.withColumn("model_type", F.col("label"))
    monkeypatch.setattr(training, "train_forest", lambda *_, **__: both.wait() is None or Echo())
    rows = spark.createDataFrame([(i, "a", str(i % 2)) for i in range(40)], "doc_id long, text string, label string")
    scores = training.cross_validate(rows, "doc_id", k=4)
    assert sorted(tuple(r) for r in scores.select("fold", "f1_macro", "n_test").collect()) == [(i, 1.0, 10) for i in range(4)]


def test_rows_to_predict_are_spread(spark, monkeypatch):
    """The staged rows lay in a few files, so a few tasks asked all trees about all rows."""
    monkeypatch.setattr(training, "train_forest", lambda rows: None)
    rows, _ = understanding._split_model(spark, SF_DIR)
    assert len(rows.inputFiles()) >= spark.sparkContext.defaultParallelism


def test_cleaned_texts_by_all_steps(spark):
    """Every step was tried on every text; now one search says which texts have any artefact, and single blanks are left alone."""
    draw, parts = random.Random(4), ["I€", 'I"s', "0", "A", "|", "§IRET", "§IREN", "§", "TVl", "TV", "l", "é", " ", "  ", "\t", "\n", "€", "I", "x", "\u00a0"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(9))) for _ in range(4000)] + [None]
    out = F.coalesce("t", F.lit(""))
    for pattern, replacement in text.OCR_CORRECTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    out = text.strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"(?md)^[^a-zA-Z0-9€\n]*(?:\n|\z)", ""))
    anything = F.lit(False)
    for pattern, _ in text.OCR_CORRECTIONS:
        anything = anything | F.col("t").rlike(pattern)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", out.alias("want"), text.clean_ocr_text(F.col("t")).alias("got"), anything.alias("any"), F.col("t").rlike(text.OCR_ARTEFACT).alias("found"))
    for row in df.collect():
        assert (row.got, row.found) == (row.want, row.any), repr(row.t)

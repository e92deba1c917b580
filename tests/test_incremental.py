"""What is built up over time: pages by key, updates in order, the sibling ledger and the dedupe of streams, stages of a run."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dossierlens.operators import filters, siblings
from dossierlens.plans.processing import process_documents
from dossierlens.sources import writers
from dossierlens.storage import WorkFolder
from dossierlens.streaming import jobs

AS_OF = datetime(2026, 1, 1, 9)


def test_pages_by_key_equal_pages_by_count(spark, tmp_path):
    rows = [(f"d{i:03d}", datetime(2024, 1, 1) + timedelta(days=i * 7 % 30)) for i in range(300)]
    spark.createDataFrame(rows, "document_id string, upload_timestamp timestamp").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    after, seen = None, []
    for page in range(7):
        found = filters.page_documents(docs, limit=47, after=after).collect()
        assert found == filters.page_documents(docs, skip=47 * page, limit=47).collect()
        seen += found
        after = (found[-1].upload_timestamp, found[-1].document_id)
    assert len({r.document_id for r in seen}) == 300 and filters.page_documents(docs, after=after).count() == 0
    far = filters.page_documents(docs, limit=47, after=after)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(upload_timestamp" in far and "TakeOrderedAndProject(limit=47" in far
    names = spark.createDataFrame([(f"s{i}", "x") for i in range(20)], "supplier_id string, name string")
    first = filters.page_suppliers(names, limit=5).collect()
    assert filters.page_suppliers(names, limit=5, after=first[-1].supplier_id).collect() == filters.page_suppliers(names, skip=5, limit=5).collect()


def test_several_patches_of_a_key_give_one_row(spark):
    docs = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 3)], "k string, status string, n int")
    patches = [("a", 1, "one", None), ("a", 2, None, 5), ("a", 3, "three", None), ("a", 3, "also", 7), ("b", 1, None, None), ("q", 1, "new", 9)]
    results = set()
    for seed in range(4):
        random.seed(seed)
        shuffled = spark.createDataFrame(random.sample(patches, len(patches)), "k string, at int, status string, n int").repartition(seed + 1)
        results.add(tuple(sorted(map(tuple, filters.sparse_update(docs, shuffled, "k", order=["at"]).collect()))))
        results.add(tuple(sorted(map(tuple, writers.merge_documents(docs, shuffled, "k", order=["at"]).collect()))))
    assert results == {(("a", "three", 7), ("b", "y", 2), ("c", "z", 3))}


def test_the_first_of_several_new_rows_is_inserted(spark):
    existing = spark.createDataFrame([("a",)], "k string")
    rows = [("a", 1, "stored"), ("b", 2, "late"), ("b", 1, "early"), ("c", 1, "y"), ("c", 1, "x"), ("c", 1, None)]
    results = set()
    for seed in range(4):
        random.seed(seed)
        new = spark.createDataFrame(random.sample(rows, len(rows)), "k string, at int, v string").repartition(seed + 1)
        results.add(tuple(sorted(map(str, writers.insert_if_absent(new, existing, "k", order=["at"]).collect()))))
    assert len(results) == 1 and "early" in str(results) and "late" not in str(results) and "stored" not in str(results)


def documents(spark, first, count):
    return spark.range(first, first + count).selectExpr(
        "concat('d', lpad(id, 6, '0')) as document_id", "concat('s', id % 25) as supplier_id", "concat('f', id) as original_filename",
        "element_at(array('FACTURE', 'DEVIS', 'RIB'), cast(id % 3 as int) + 1) as doc_type", "'processed' as status",
        "named_struct('siret', concat('n', if(id % 17 = 0, id % 5, id % 25))) as extracted")


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_sibling_ledger_costs_the_batch_only(spark, tmp_path):
    silver, conflicts, groups = (str(tmp_path / n) for n in ("silver", "conflicts", "ledger"))
    ledger = jobs.SiblingLedger(spark, groups, buckets=4)
    sizes = []
    for batch in range(20):
        jobs.check_siblings(documents(spark, 100 * batch, 100), batch, silver, conflicts, ledger)
        sizes.append(folder_bytes(f"{groups}/groups/batch={batch}"))
        if batch == 15:  # documents of earlier batches are not read again
            for old in range(15):
                for name in os.listdir(f"{silver}/batch={old}"):
                    if name.endswith(".parquet"):
                        os.rename(f"{silver}/batch={old}/{name}", f"{silver}/batch={old}/{name}.away")
    assert max(sizes[2:]) < 1.2 * min(sizes[2:])  # the groups of 25 suppliers, however many documents came
    before = sorted(map(str, spark.read.parquet(f"{conflicts}/batch=19").collect()))
    jobs.check_siblings(documents(spark, 1900, 100).repartition(3), 19, silver, conflicts, ledger)
    assert sorted(map(str, spark.read.parquet(f"{conflicts}/batch=19").collect())) == before
    for old in range(15):
        for name in os.listdir(f"{silver}/batch={old}"):
            if name.endswith(".away"):
                os.rename(f"{silver}/batch={old}/{name}", f"{silver}/batch={old}/{name[:-5]}")
    found = {r.document_id: (int(r.details["siblings"]), int(r.details["other_sirets"]), r.related_document_id)
             for r in jobs.sibling_findings(spark, silver, conflicts, AS_OF).collect()}
    want = {r.document_id: (r.n_mismatch, r.n_other_sirets, r.related_document_id)
            for r in siblings.sibling_siret_mismatch(documents(spark, 0, 2000)).collect()}
    assert found == want and len(want) > 100


def test_stream_dedupe_forgets_after_its_delay(spark, tmp_path):
    day = datetime(2024, 1, 1)
    schema = "document_id string, upload_timestamp timestamp"
    batches = [[("a", 0), ("a", 1), ("b", 0)], [("a", 3), ("c", 20)], [("e", 21)], [("a", 22), ("b", 2), ("c", 23)], [("d", 40)]]
    for number, rows in enumerate(batches):
        path = str(tmp_path / "in" / f"{number}.parquet")
        spark.createDataFrame([(k, day + timedelta(days=d)) for k, d in rows], schema).coalesce(1).write.parquet(path)
        inner = [f for f in os.listdir(path) if f.startswith("part-")][0]
        os.makedirs(tmp_path / "files", exist_ok=True)
        os.rename(f"{path}/{inner}", tmp_path / "files" / f"{number}.parquet")
        os.utime(tmp_path / "files" / f"{number}.parquet", (1e9 + number, 1e9 + number))
    stream = jobs.file_stream(spark, str(tmp_path / "files"), schema, max_files=1)
    out = str(tmp_path / "out")
    jobs.write_batches(jobs.stream_dedupe(stream, "7 days"), out, str(tmp_path / "checkpoint")).awaitTermination()
    rows = sorted((r.document_id, (r.upload_timestamp - day).days) for r in spark.read.option("basePath", out).parquet(out).collect())
    # a on day 22 is a new document (its state is gone), b on day 2 is late and dropped, c on day 23 repeats.
    assert [r for r in rows if r not in (("a", 0), ("a", 1))] == [("a", 22), ("b", 0), ("c", 20), ("d", 40), ("e", 21)]
    assert len(rows) == 6


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        [("d1", "s", "a.pdf", "FACTURE N° F-1\nSIRET : 73282932000074\nDate d'émission : 13/02/1985\nTotal HT : 12 000 000,00 €\nTotal TTC : 14 400 000,00 €", 0.9),
         ("d2", "s", "b.pdf", " \n", 0.9), ("d3", "s", "c.pdf", None, 0.0)],
        "document_id string, supplier_id string, original_filename string, ocr_text string, ocr_quality_score double")


def test_chain_keeps_large_amounts_and_old_dates(spark, raw):
    suppliers = spark.createDataFrame([("s", "S", "pending")], "supplier_id string, name string, compliance_status string")
    with WorkFolder(spark) as work:
        done = process_documents(raw, suppliers, AS_OF, work=work)
        row = done.documents.first()
        assert (row.extracted.montant_ht, row.extracted.montant_ttc, row.extracted.date_emission) == (12_000_000.0, 14_400_000.0, "1985-02-13")
        assert [(r.document_id, r.status) for r in done.documents.collect()] == [("d1", "processed")]
        assert sorted((r.document_id, r.status, r.error_message) for r in done.failed.collect()) == [
            ("d2", "error", "no readable text"), ("d3", "error", "no readable text")]
        assert {"d2", "d3"} <= {r.document_id for r in done.checks.collect()}
        path = work.root.removeprefix("file:")
        assert os.listdir(path)
    assert not os.path.exists(path)
    limited = process_documents(raw, suppliers, AS_OF, amount_limit=10_000_000.0, years=(1990, 2050)).documents.first()
    assert (limited.extracted.montant_ht, limited.extracted.date_emission) == (None, None)


def test_a_run_leaves_no_stage_behind(spark, raw):
    suppliers = spark.createDataFrame([("s", "S", "pending")], "supplier_id string, name string, compliance_status string")
    from dossierlens.storage import work_dir
    stages = f"{work_dir(spark)}/stages".removeprefix("file:")
    before = set(os.listdir(stages)) if os.path.exists(stages) else set()
    with WorkFolder(spark) as work:
        done = process_documents(raw, suppliers, AS_OF, work=work)
        done.suppliers.collect(), done.anomalies.collect(), done.documents.collect()
    assert set(os.listdir(stages)) == before

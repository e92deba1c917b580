"""Skewed groups, ranks, order of input rows and streams against simple definitions."""

from datetime import datetime

from pyspark.sql import functions as F

from dossierlens.operators import classify, joins, ocr, ranking, siblings, synth, training
from dossierlens.plans.processing import process_documents
from dossierlens.sources import readers, writers

PAIR_COLUMNS = ["document_id", "sibling_document_id", "siret", "sibling_siret"]


def hot_documents(spark, n=400):
    """One supplier holds most documents and most of them share a SIRET."""
    return spark.range(n).selectExpr(
        "concat('d', id) as document_id", "if(id % 5 < 4, 'hot', concat('s', id % 7)) as supplier_id",
        "concat('f', id) as original_filename",
        "element_at(array('FACTURE', 'DEVIS', 'RIB'), cast(id % 3 as int) + 1) as doc_type",
        "element_at(array('processed', 'pending', 'extracted'), cast(id div 3 % 3 as int) + 1) as status",
        "named_struct('siret', case when id % 11 = 0 then concat('x', id) when id % 13 = 0 then '' else 'same' end) "
        "as extracted")


def brute_force(df):
    rows = df.collect()
    return sorted(
        (a.document_id, c.document_id, a.extracted.siret, c.extracted.siret) for a in rows for c in rows
        if a.supplier_id == c.supplier_id and a.document_id != c.document_id and a.doc_type != "DEVIS"
        and c.status in ("processed", "extracted") and a.extracted.siret and c.extracted.siret
        and a.extracted.siret != c.extracted.siret)


def findings(pairs):
    """Per document: number of differing siblings and SIRETs, smallest sibling."""
    out = {}
    for document, sibling, _, siret in pairs:
        out.setdefault(document, []).append((sibling, siret))
    return {d: (len(v), len({s for _, s in v}), min(v)[0]) for d, v in out.items()}


def found(df):
    return {r.document_id: (r.n_mismatch, r.n_other_sirets, r.related_document_id) for r in df.collect()}


def test_one_finding_per_document(spark):
    docs = hot_documents(spark)
    want = brute_force(docs)
    rows = siblings.sibling_siret_mismatch(docs)
    assert found(rows) == findings(want) and rows.count() == len(findings(want))
    pairs = siblings.sibling_pairs(docs, docs).select(*PAIR_COLUMNS).collect()
    assert sorted(tuple(r) for r in pairs) == want
    listed = siblings.sibling_pairs(docs, docs.where("document_id = 'd0'")).select(*PAIR_COLUMNS).collect()
    assert sorted(tuple(r) for r in listed) == [p for p in want if p[0] == "d0"]
    counts = {(r.supplier_id, r.siret): r.n_mismatch for r in siblings.mismatch_counts(docs).collect()}
    assert sum(1 for a in want if a[0] == want[0][0]) == counts[("hot", want[0][2])]
    assert siblings.sibling_siret_mismatch(docs.where("false")).count() == 0


def test_stored_documents_are_restated(spark):
    docs = hot_documents(spark)
    is_new = "cast(substr(document_id, 2) as int) >= 200"
    first, second = docs.where(f"not {is_new}"), docs.where(is_new)
    rows = siblings.sibling_siret_mismatch(second, stored=first)
    assert found(siblings.sibling_siret_mismatch(first)) | found(rows) == findings(brute_force(docs))
    before = findings(brute_force(first))
    stale = {d for d, f in findings(brute_force(docs)).items() if int(d[1:]) < 200 and before.get(d) != f}
    assert {r.document_id for r in rows.where("not fresh").collect()} == stale


def test_ranks(spark):
    df = spark.range(500).selectExpr("concat('k', lpad(id, 4, '0')) as k", "id % 3 as label")
    wrong = ranking.global_row_number(df.repartition(5), "k", partition_rows=60).where("row_index <> cast(substr(k, 2) as int)")
    assert wrong.count() == 0
    ranks = ranking.shuffled_rank(df, ["label"], "k")
    again = ranking.shuffled_rank(df.repartition(3), ["label"], "k")
    assert sorted(map(tuple, ranks.collect())) == sorted(map(tuple, again.collect()))
    assert sorted(r.rank for r in ranks.where("label = 0").collect()) == list(range(167))
    for rows in (60, 1000):  # a class over several partitions, and several classes in one
        parts = ranking.shuffled_rank(df, ["label"], "k", total="n", partition_rows=rows).collect()
        assert sorted(tuple(r)[:3] for r in parts) == sorted(map(tuple, ranks.collect())) and {r.n for r in parts} == {166, 167}


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition"), plan.count("Scan "), plan.count("ubquery")


def test_rank_plans(spark):
    df = spark.range(5000).selectExpr("concat('k', id) as k", "cast(id % 3 as int) as label")
    shuffles, scans, subqueries = exchanges(training.stratified_split(df, "k"))
    assert shuffles <= 2 and subqueries == 0
    suppliers = spark.range(500).selectExpr("concat('s', lpad(id, 4, '0')) as supplier_id")
    shuffles, scans, subqueries = exchanges(joins.expand_document_plan(suppliers))
    assert shuffles == 0 and scans <= 2 and subqueries == 0


def test_noise_is_reproducible_and_grows(spark):
    df = spark.range(50).selectExpr("id", "repeat('Cette facture contient plusieurs mots utiles\n', 6) as text")
    mild, strong = (
        {r.id: r.text for r in synth.augment_text_noise(df.repartition(n), F.lit(s), "id").collect()}
        for n, s in ((2, 0.1), (5, 0.85)))
    again = {r.id: r.text for r in synth.augment_text_noise(df, F.lit(0.85), "id").collect()}
    assert strong == again
    original = df.first().text
    assert sum(t != original for t in strong.values()) > sum(t != original for t in mild.values())


def test_ocr_choice_and_pages(spark):
    words = spark.createDataFrame(
        [("d", 1, 0, 1, 1, 2, 2, "monde", 90.0), ("d", 1, 0, 1, 1, 2, 1, "Bonjour", 50.0), ("d", 1, 0, 1, 1, 1, 1, "x", 10.0),
         ("e", 1, 0, 1, 1, 1, 1, " ", 95.0)],
        "document_id string, page int, pass_no int, block_num int, par_num int, line_num int, word_num int, text string, "
        "conf double")
    got = {r.document_id: (r.text, r.confidence) for r in ocr.reconstruct_lines(words).collect()}
    assert got == {"d": ("Bonjour monde", 0.7), "e": ("", 0.0)}


def test_raw_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("FACTURE N° 1 \xe9\nligne".encode("latin-1"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.exe").write_bytes(b"MZ")
    accepted, rejected = readers.read_raw(spark, str(tmp_path))
    assert [r.mime_type for r in accepted.collect()] == ["application/pdf"]
    assert {r.reason for r in rejected.collect()} == {"mime_type"}
    texts, _ = readers.read_raw(spark, str(tmp_path), accepted=["text/plain"])
    row = readers.decode_text(texts).first()
    assert row.text.startswith("FACTURE N") and row.word_count == 5 and row.confidence == 1.0


def test_missing_model_leaves_keywords(spark, tmp_path):
    assert training.TrainedClassifier.load(str(tmp_path / "none")) is None
    df = spark.createDataFrame([("extrait kbis du greffier",), ("  ",), ("rien",)], "ocr_text string")
    assert [r.doc_type for r in classify.classify(df).collect()] == ["KBIS", "UNKNOWN", "UNKNOWN"]


def test_replay_gives_the_same_anomalies(spark):
    raw = spark.createDataFrame(
        [("d1", "s", "a.pdf", "ATTESTATION DE VIGILANCE URSSAF\nSIRET : 73282932000074", 0.9),
         ("d2", "s", "b.pdf", "EXTRAIT KBIS greffier\nSIRET : 41816609600069", 0.1)],
        "document_id string, supplier_id string, original_filename string, ocr_text string, ocr_quality_score double")
    suppliers = spark.createDataFrame([("s", "S", "pending")], "supplier_id string, name string, compliance_status string")
    as_of = datetime(2026, 1, 1, 9)
    first = process_documents(raw, suppliers, as_of)
    ids = sorted(r.anomaly_id for r in first.anomalies.collect())
    second = process_documents(raw.repartition(4), suppliers, as_of, anomalies_so_far=first.anomalies)
    assert sorted(r.anomaly_id for r in second.anomalies.collect()) == ids
    kinds = sorted((r.document_id, r.type) for r in first.anomalies.collect())
    assert kinds == [("d1", "MISSING_FIELD"), ("d1", "MISSING_FIELD"), ("d1", "SIRET_MISMATCH"),
                     ("d2", "KBIS_EXPIRED"), ("d2", "SIRET_MISMATCH")]
    assert [r.compliance_status for r in second.suppliers.collect()] == ["non_compliant"]
    early = process_documents(raw.where("document_id = 'd1'"), suppliers, as_of)
    late = process_documents(raw.where("document_id = 'd2'"), suppliers, as_of, anomalies_so_far=early.anomalies,
                             documents_so_far=early.documents)
    assert sorted(r.anomaly_id for r in late.anomalies.collect()) == ids
    assert [(r.document_id, r.validation.checks[-1].rule) for r in late.restated.collect()] == [("d1", "siret_consistency")]
    nested = {r.document_id: r.validation for r in first.documents.collect()}
    assert nested["d1"].status == "error" and "siret_consistency" in [c.rule for c in nested["d2"].checks]


def test_set_updates(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "document_id string, status string")
    updates = spark.createDataFrame([("b", "z"), ("c", "w")], "document_id string, status string")
    assert sorted(map(tuple, writers.merge_documents(docs, updates).collect())) == [("a", "x"), ("b", "z")]
    assert [r.document_id for r in writers.insert_if_absent(updates, docs, "document_id").collect()] == ["c"]

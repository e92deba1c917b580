"""Queries over sources, sinks, filters, pages and set operations."""

from functools import reduce

from pyspark.sql import functions as F

from dossierlens import schemas
from dossierlens.catalog import bindings as b
from dossierlens.catalog.reference_sql import ANO, DOC, PRED, SUP, sql
from dossierlens.catalog.registry import CHECKS, query
from dossierlens.functions import text as tx
from dossierlens.operators import extraction, filters, joins, ranking, rules, training
from dossierlens.sources import readers, writers
from dossierlens.storage import scratch_path

DOC_COLUMNS = ["document_id", "supplier_id", "doc_type", "status"]
ANO_COLUMNS = ["anomaly_id", "supplier_id", "type", "severity", "resolved"]


# Sources and sinks

@query("s03_ocr_words", """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    w AS (SELECT doc_id, line, unnest(string_split(t, ' ')) AS word,
        generate_subscripts(string_split(t, ' '), 1) - 1 AS pos FROM l)
    SELECT 'doc-' || doc_id AS document_id, cast(count(*) AS bigint) AS words,
        cast(count(CASE WHEN (doc_id * 7 + line * 11 + pos * 37) % 101 >= 40 THEN 1 END) AS bigint) AS confident
    FROM w GROUP BY doc_id""")
def ocr_words(spark, sf_dir):
    path = scratch_path(spark, "ocr-words")
    b.ocr_words(spark, sf_dir).write.parquet(path)
    words = readers.read_ocr_words(spark, path)
    return words.groupBy("document_id").agg(
        F.count("*").alias("words"), F.count_if(F.col("conf") >= 40).alias("confident"))


@query("s04_read_documents", sql(DOC, """
    SELECT doc_type, status, cast(count(*) AS bigint) AS n, cast(count(siret) AS bigint) AS n_siret
    FROM doc GROUP BY doc_type, status"""))
def read_documents(spark, sf_dir):
    path = scratch_path(spark, "documents")
    b.documents(spark, sf_dir).write.parquet(path)
    return readers.read_documents(spark, path).groupBy("doc_type", "status").agg(
        F.count("*").alias("n"), F.count("extracted.siret").alias("n_siret"))


@query("s04_read_suppliers", sql(SUP, "SELECT supplier_id, name, siret, siren, tva_number, address FROM sup"))
def read_suppliers(spark, sf_dir):
    path = scratch_path(spark, "suppliers")
    b.suppliers(spark, sf_dir).write.parquet(path)
    return readers.read_suppliers(spark, path).select(
        "supplier_id", "name", "siret", "siren", "tva_number", "address")


@query("s05_write_clean", """
    SELECT strftime(l_shipdate, '%Y-%m') AS ingest_month, cast(count(*) AS bigint) AS n FROM lineitem GROUP BY 1""")
def write_clean(spark, sf_dir):
    path = scratch_path(spark, "clean")
    writers.write_clean(b.documents(spark, sf_dir), path)
    clean = "document_id string, text string, ocr_quality_score double, ingest_month string"
    return spark.read.schema(clean).parquet(path).groupBy("ingest_month").agg(F.count("*").alias("n"))


@query("s06_write_curated", sql(DOC, """
    SELECT document_id, supplier_id, doc_type, siret, montant_ttc, date_expiration, ocr_quality_score FROM doc"""))
def write_curated(spark, sf_dir):
    path = scratch_path(spark, "curated")
    docs = b.documents(spark, sf_dir).withColumns({
        "classification_confidence": F.lit(1.0), "validation": F.lit(None).cast(schemas.VALIDATION)})
    writers.write_curated(docs, path, b.AS_OF)
    wanted = "document_id string, supplier_id string, doc_type string, ocr_quality_score double, extracted struct<siret:string,montant_ttc:double,date_expiration:string>"
    return spark.read.schema(wanted).json(path).select(
        "document_id", "supplier_id", "doc_type", "extracted.siret", "extracted.montant_ttc",
        "extracted.date_expiration", "ocr_quality_score")


@query("s07_merge_documents", sql(DOC, """
    SELECT document_id, CASE WHEN l_partkey % 5 = 0 THEN 'validated' ELSE status END AS status,
        CASE WHEN l_partkey % 5 = 0 AND l_partkey % 2 = 0 THEN 'KBIS' ELSE doc_type END AS doc_type FROM doc"""))
def merge_documents(spark, sf_dir):
    docs = b.documents_flat(spark, sf_dir)
    updates = docs.where("l_partkey % 5 = 0").select(
        "document_id", F.lit("validated").alias("status"),
        F.when(F.col("l_partkey") % 2 == 0, F.lit("KBIS")).alias("doc_type"))
    return writers.merge_documents(docs.select("document_id", "status", "doc_type"), updates)


@query("s08_append_anomalies", sql(ANO, """
    SELECT type, severity, cast(count(*) AS bigint) AS n, cast(count(DISTINCT anomaly_id) AS bigint) AS n_ids
    FROM ano GROUP BY type, severity"""))
def append_anomalies(spark, sf_dir):
    path = scratch_path(spark, "anomalies")
    rows = b.anomalies(spark, sf_dir)
    half = F.pmod(F.xxhash64("anomaly_id"), F.lit(2))
    for part in range(2):
        writers.append_anomalies(rows.where(half == part), path)
    return readers.read_anomalies(spark, path).groupBy("type", "severity").agg(
        F.count("*").alias("n"), F.countDistinct("anomaly_id").alias("n_ids"))


@query("s09_write_training_set", """
    SELECT cast(quality AS varchar) AS label, cast(count(*) AS bigint) AS n,
        cast(sum(length(text)) AS bigint) AS chars
    FROM labels JOIN documents USING (doc_id) GROUP BY quality""")
def write_training_set(spark, sf_dir):
    path = scratch_path(spark, "training-set")
    rows = b.predictions(spark, sf_dir).select("text", F.col("label").cast("string").alias("label"))
    writers.write_training_set(rows, path)
    return readers.read_training_rows(spark, path, "json").groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s10_write_manifest", sql(SUP, """
    , plan(doc_type, degradation, severity) AS (VALUES ('FACTURE', 'high_quality', 0.1::double), ('DEVIS', 'noise', 0.3),
      ('KBIS', 'rotation', 0.2), ('URSSAF', 'high_quality', 0.1), ('SIRET', 'high_quality', 0.1),
      ('RIB', 'high_quality', 0.1))
    SELECT name AS company_name, siret, siren, doc_type, degradation, severity,
      '/data/' || siret || '/' || lower(doc_type) || '.pdf' AS pdf_path,
      '/data/' || siret || '/' || lower(doc_type) || '_scan.jpg' AS jpg_path FROM sup, plan"""))
def write_manifest(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    planned = joins.expand_all_types(b.suppliers(spark, sf_dir))
    writers.write_manifest(planned, "/data", path)
    return spark.read.schema(writers.manifest(planned, "/data").schema).json(path)


@query("s11_training_report", sql(PRED, """
    , p AS (SELECT *, doc_id % 5 AS fold FROM pred),
    scopes AS (SELECT -1 AS fold UNION ALL SELECT * FROM range(5)),
    s AS (SELECT s.fold AS scope_fold, p.label, p.prediction, p.confidence FROM scopes s JOIN p ON s.fold IN (-1, p.fold)),
    cls AS (SELECT scope_fold, c, count(CASE WHEN label = c THEN 1 END) AS support, count(CASE WHEN prediction = c THEN 1 END) AS predicted,
        count(CASE WHEN label = c AND prediction = c THEN 1 END) AS hits FROM s, (VALUES (0), (1)) v(c) GROUP BY scope_fold, c),
    rep AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hits::double / predicted END AS precision,
        CASE WHEN support = 0 THEN 0.0 ELSE hits::double / support END AS recall, 2.0 * hits / (support + predicted) AS f1 FROM cls
        WHERE support + predicted > 0),
    met AS (SELECT scope_fold, sum(hits)::double / sum(support) AS accuracy, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted,
        sum(support)::double AS n_test FROM rep GROUP BY scope_fold),
    overall AS (SELECT *, (SELECT avg(confidence) FROM pred WHERE label = prediction) AS sure FROM met WHERE scope_fold = -1),
    cv AS (SELECT avg(f1_macro) AS m, stddev_pop(f1_macro) AS sd FROM met WHERE scope_fold >= 0)
    SELECT scope, name, round(v, 6) AS number, text FROM (
      SELECT 'overall' AS scope, unnest(['accuracy', 'f1_macro', 'f1_weighted', 'avg_confidence_correct', 'n_test']) AS name,
        unnest([accuracy, f1_macro, f1_weighted, sure, n_test]) AS v, NULL::varchar AS text FROM overall
      UNION ALL SELECT 'overall', 'verdict', NULL, CASE WHEN accuracy >= 0.92 AND f1_macro >= 0.90 THEN 'EXCELLENT' WHEN accuracy >= 0.85 AND f1_macro >= 0.82
        THEN 'BON' WHEN accuracy >= 0.75 THEN 'ACCEPTABLE' ELSE 'INSUFFISANT' END FROM overall
      UNION ALL SELECT 'overall', unnest(['cv_f1_macro_mean', 'cv_f1_macro_std']), unnest([m, sd]), NULL FROM cv
      UNION ALL SELECT cast(c AS varchar), unnest(['precision', 'recall', 'f1', 'support']), unnest([precision, recall, f1, support::double]), NULL
        FROM rep WHERE scope_fold = -1)"""))
def training_report(spark, sf_dir):
    """The report of a training run, written and read back; folds are dealt by the id."""
    path = scratch_path(spark, "training-report")
    rows = b.predictions(spark, sf_dir)
    folds = reduce(lambda a, c: a.unionByName(c), [
        training.evaluate(rows.where(F.col("doc_id") % training.FOLDS == k), confidence="confidence").select("f1_macro") for k in range(training.FOLDS)])
    report = writers.training_report(
        training.evaluate(rows, confidence="confidence"), training.cross_validation_summary(folds),
        training.per_class_report(rows))
    writers.write_training_report(report, path)
    read = spark.read.schema("scope string, name string, value string").json(path)
    number = F.col("value").try_cast("double")
    return read.select("scope", "name", F.round(number, 6).alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


@query("s13_flatten_registry", """
    SELECT CASE s_suppkey % 4 WHEN 0 THEN upper(s_name) WHEN 1 THEN upper('usuel ' || s_name)
        WHEN 2 THEN upper('Nom' || s_suppkey || ' Jean') ELSE 'ENTREPRISE INCONNUE' END AS name,
      cast(10000000000000 + s_suppkey AS varchar) AS siret, cast(100000000 + s_suppkey AS varchar) AS siren,
      CASE WHEN s_suppkey % 3 = 0 THEN '75001 ' || n_name ELSE s_suppkey || ' RUE HAUTE, 75001 ' || n_name END AS address
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def flatten_registry(spark, sf_dir):
    path = scratch_path(spark, "registry")
    joined = b.table(spark, sf_dir, "supplier").join(
        b.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined.selectExpr("""array(named_struct(
        'siret', cast(10000000000000 + s_suppkey as string), 'siren', cast(100000000 + s_suppkey as string),
        'uniteLegale', named_struct(
          'denominationUniteLegale', case when s_suppkey % 4 = 0 then s_name else '' end,
          'denominationUsuelle1UniteLegale', case when s_suppkey % 4 = 1 then concat('usuel ', s_name) end,
          'nomUniteLegale', case when s_suppkey % 4 = 2 then concat('Nom', s_suppkey) else '' end,
          'prenom1UniteLegale', case when s_suppkey % 4 = 2 then 'Jean' end),
        'adresseEtablissement', named_struct(
          'numeroVoieEtablissement', case when s_suppkey % 3 <> 0 then cast(s_suppkey as string) end,
          'typeVoieEtablissement', case when s_suppkey % 3 <> 0 then 'RUE' else '' end,
          'libelleVoieEtablissement', case when s_suppkey % 3 <> 0 then 'HAUTE' end,
          'codePostalEtablissement', '75001', 'libelleCommuneEtablissement', n_name))) as etablissements""").write.json(path)
    return readers.flatten_registry(readers.read_registry(spark, path, lines=True))


@query("s14_insert_if_absent", sql(SUP, """
    SELECT DISTINCT 'sup-' || l_suppkey AS supplier_id FROM lineitem
    WHERE 'sup-' || l_suppkey NOT IN (SELECT supplier_id FROM sup WHERE s_suppkey % 3 <> 0)"""))
def insert_if_absent(spark, sf_dir):
    existing = b.suppliers(spark, sf_dir).where("cast(substr(supplier_id, 5) as int) % 3 <> 0")
    return writers.insert_if_absent(
        b.documents(spark, sf_dir).select("supplier_id"), existing.select("supplier_id"), "supplier_id")


@query("s14_conflicts", sql(SUP, DOC, """
    SELECT document_id, siret FROM doc WHERE siret IN (SELECT siret FROM sup WHERE s_suppkey % 3 = 0)"""))
def insert_conflicts(spark, sf_dir):
    existing = b.suppliers(spark, sf_dir).where("cast(substr(supplier_id, 5) as int) % 3 = 0")
    return writers.conflicts(b.documents_flat(spark, sf_dir).select("document_id", "siret"), existing, "siret")


@query("s15_delete_cascade", sql(ANO, """
    , kept AS (SELECT DISTINCT 'doc-' || user_id AS document_id, user_id FROM events WHERE user_id % 3 <> 0)
    SELECT document_id, (SELECT cast(count(*) AS bigint) FROM ano WHERE ano.document_id = kept.document_id) AS anomalies
    FROM kept"""))
def delete_cascade(spark, sf_dir):
    anomalies = b.anomalies(spark, sf_dir)
    docs = anomalies.select("document_id").distinct()
    ids = docs.where("cast(substr(document_id, 5) as bigint) % 3 = 0")
    left_docs, left_anomalies = writers.delete_cascade(docs, anomalies, ids)
    counts = left_anomalies.groupBy("document_id").agg(F.count("*").alias("anomalies"))
    return left_docs.join(counts, "document_id", "left").select(
        "document_id", F.coalesce("anomalies", F.lit(0).cast("bigint")).alias("anomalies"))


@query("s16_reset_status", sql(DOC, """
    SELECT document_id, CASE WHEN status = 'error' THEN 'pending' ELSE status END AS status,
      CASE WHEN status = 'classified' THEN 'kept' END AS error_message FROM doc"""))
def reset_status(spark, sf_dir):
    docs = b.documents(spark, sf_dir).select(
        "document_id", "status",
        F.when(F.col("status") == "error", "lost").when(F.col("status") == "classified", "kept").alias("error_message"))
    return filters.reset_status(docs, docs.where("status = 'error'"))


# Filters and projections

@query("f01_filter_documents", sql(DOC, """
    SELECT document_id, supplier_id, doc_type, status FROM doc
    WHERE supplier_id = 'sup-7' AND doc_type = 'FACTURE' AND status = 'processed'"""))
def filter_documents(spark, sf_dir):
    return filters.filter_documents(b.documents(spark, sf_dir), "sup-7", "FACTURE", "processed").select(*DOC_COLUMNS)


@query("f02_filter_anomalies", sql(ANO, """
    SELECT anomaly_id, supplier_id, type, severity, resolved FROM ano
    WHERE severity = 'error' AND type = 'KBIS_EXPIRED' AND NOT resolved"""))
def filter_anomalies(spark, sf_dir):
    return filters.filter_anomalies(
        b.anomalies(spark, sf_dir), severity="error", type="KBIS_EXPIRED", resolved=False).select(*ANO_COLUMNS)


@query("f03_search_suppliers", sql(SUP, r"""
    SELECT supplier_id, name, siret FROM sup WHERE (regexp_matches(name, '(?i)supplier#0+1\d$')
      OR regexp_matches(siret, 'supplier#0+1\d$')) AND compliance_status = 'warning'"""))
def search_suppliers(spark, sf_dir):
    return filters.search_suppliers(b.suppliers(spark, sf_dir), r"supplier#0+1\d$", "warning").select(
        "supplier_id", "name", "siret")


@query("f04_search_suppliers_literal", sql(SUP, """
    SELECT supplier_id, name, siret FROM sup WHERE contains(lower(name), '00001') OR contains(siret, '00001')"""))
def search_suppliers_literal(spark, sf_dir):
    return filters.search_suppliers_literal(b.suppliers(spark, sf_dir), "00001").select("supplier_id", "name", "siret")


@query("f05_filter_filename", sql(DOC, """
    SELECT document_id, original_filename FROM doc WHERE contains(lower(original_filename), 'kbis-1')"""))
def filter_filename(spark, sf_dir):
    return filters.filter_filename(b.documents(spark, sf_dir), "KBIS-1").select("document_id", "original_filename")


@query("f06_get_by_id", sql(ANO, "SELECT anomaly_id, message FROM ano WHERE anomaly_id = 'an-42'"))
def get_by_id(spark, sf_dir):
    return filters.get_by_id(b.anomalies(spark, sf_dir), "anomaly_id", "an-42").select("anomaly_id", "message")


@query("f07_status_in", sql(DOC, """
    SELECT document_id, status FROM doc WHERE status IN ('extracted', 'validated', 'processed')"""))
def status_in(spark, sf_dir):
    return filters.status_in(b.documents(spark, sf_dir), schemas.SIBLING_STATUSES).select("document_id", "status")


@query("f07_status_not_in", sql(DOC, "SELECT document_id, status FROM doc WHERE status NOT IN ('processed', 'error')"))
def status_not_in(spark, sf_dir):
    return filters.status_in(b.documents(spark, sf_dir), ["processed", "error"], negate=True).select(
        "document_id", "status")


@query("f08_list_projection", sql(DOC, """
    SELECT document_id, supplier_id, original_filename, doc_type, status, upload_timestamp,
      0.5::double AS classification_confidence, CASE WHEN montant_ttc IS NULL THEN 'warning' ELSE 'ok' END
      AS validation_status FROM doc"""))
def list_projection(spark, sf_dir):
    status = F.when(F.col("extracted.montant_ttc").isNull(), F.lit("warning")).otherwise(F.lit("ok"))
    docs = b.documents(spark, sf_dir).withColumns({
        "classification_confidence": F.lit(0.5), "validation": F.struct(status.alias("status"))})
    return filters.list_projection(docs)


@query("f09_document_view", sql(DOC, """
    SELECT document_id, 'raw' AS zone, status, siret, montant_ttc, NULL::varchar AS validation_status FROM doc"""))
def document_view(spark, sf_dir):
    path = scratch_path(spark, "documents")
    b.documents(spark, sf_dir).write.parquet(path)
    return filters.document_view(readers.read_documents(spark, path)).select(
        "document_id", "zone", "status", "extracted.siret", "extracted.montant_ttc",
        F.col("validation.status").alias("validation_status"))


@query("f10_compact_extracted", sql(DOC, """
    SELECT document_id, cast((siret IS NOT NULL)::int + (siren IS NOT NULL)::int + (tva_number IS NOT NULL)::int
      + (montant_ht IS NOT NULL)::int + (montant_tva IS NOT NULL)::int + (montant_ttc IS NOT NULL)::int
      + (taux_tva IS NOT NULL)::int + (date_emission IS NOT NULL)::int + (date_echeance IS NOT NULL)::int
      + (date_expiration IS NOT NULL)::int + (numero_document IS NOT NULL)::int + (raison_sociale IS NOT NULL)::int
      + (iban IS NOT NULL)::int + (bic IS NOT NULL)::int + (banque IS NOT NULL)::int + (adresse IS NOT NULL)::int
      AS integer) AS fields_found, siret AS siret, bic AS bic FROM doc"""))
def compact_extracted(spark, sf_dir):
    found = b.documents(spark, sf_dir).select(
        "document_id", extraction.compact_extracted(F.col("extracted")).alias("found"))
    return found.select(
        "document_id", F.size("found").alias("fields_found"), F.try_element_at("found", F.lit("siret")).alias("siret"),
        F.try_element_at("found", F.lit("bic")).alias("bic"))


@query("f11_validate_supplier_input", sql(SUP, """
    SELECT supplier_id, CASE WHEN s_suppkey % 5 = 0 THEN substr(siret, 1, 9) ELSE siren END AS siren,
      cast((s_suppkey % 6 = 0)::int + (email = 'no mail')::int AS integer) AS n_problems,
      'pending' AS compliance_status
    FROM (SELECT s_suppkey, supplier_id, siret, siren, coalesce(email, '') AS email FROM sup)"""))
def validate_supplier_input(spark, sf_dir):
    key = F.expr("cast(substr(supplier_id, 5) as int)")
    rows = b.suppliers(spark, sf_dir).withColumns({
        "siren": F.when(key % 5 != 0, F.col("siren")),
        "name": F.when(key % 6 != 0, F.col("name")).otherwise(F.lit("")),
    })
    accepted, rejected = filters.validate_supplier_input(rows)
    columns = ["supplier_id", "siren", "compliance_status"]
    return accepted.select(*columns, F.lit(0).alias("n_problems")).unionByName(
        rejected.select(*columns, F.size("problems").alias("n_problems")))


@query("f12_sparse_update", sql(SUP, """
    SELECT supplier_id, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'renamed' ELSE name END AS name,
      CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 = 0 THEN 'here' ELSE address END AS address,
      s_suppkey % 3 = 0 AND (s_suppkey % 2 = 0 OR s_suppkey % 4 = 0) AS bumped FROM sup"""))
def sparse_update(spark, sf_dir):
    rows = b.suppliers(spark, sf_dir)
    key = F.expr("cast(substr(supplier_id, 5) as int)")
    patch = rows.where(key % 3 == 0).select(
        "supplier_id", F.when(key % 2 == 0, F.lit("renamed")).alias("name"),
        F.when(key % 4 == 0, F.lit("here")).alias("address"))
    return filters.sparse_update(rows, patch, "supplier_id", b.AS_OF).select(
        "supplier_id", "name", "address", (F.col("updated_at") != F.col("created_at")).alias("bumped"))


@query("f13_usable", """
    SELECT doc_id FROM documents
    WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) > 20 AND (doc_id % 100) / 100.0 > 0.2""")
def usable(spark, sf_dir):
    rows = b.table(spark, sf_dir, "documents").withColumn("confidence", F.expr("(doc_id % 100) / 100.0D"))
    return filters.usable(rows).select("doc_id")


@query("f14_split_resolved", sql(ANO, "SELECT resolved, cast(count(*) AS bigint) AS n FROM ano GROUP BY resolved"))
def split_resolved(spark, sf_dir):
    open_, done = filters.split_resolved(b.anomalies(spark, sf_dir))
    return open_.unionByName(done).groupBy("resolved").agg(F.count("*").alias("n"))


@query("f15_expiration_anomalies", sql(ANO, """
    SELECT anomaly_id, type, detected_at FROM ano
    WHERE type IN ('DATE_EXPIRED', 'KBIS_EXPIRED', 'URSSAF_EXPIRED') AND NOT resolved"""))
def expiration_anomalies(spark, sf_dir):
    return filters.expiration_anomalies(b.anomalies(spark, sf_dir)).select("anomaly_id", "type", "detected_at")


# Pages and top-k

@query("l01_page_documents", sql(DOC, """
    SELECT document_id, upload_timestamp FROM doc ORDER BY upload_timestamp DESC, document_id LIMIT 50 OFFSET 100"""))
def page_documents(spark, sf_dir):
    return filters.page_documents(b.documents(spark, sf_dir).select("document_id", "upload_timestamp"), 100, 50)


@query("l02_page_anomalies", sql(ANO, """
    SELECT anomaly_id, detected_at FROM ano ORDER BY detected_at DESC, anomaly_id LIMIT 1000 OFFSET 20"""))
def page_anomalies(spark, sf_dir):
    return filters.page_anomalies(b.anomalies(spark, sf_dir).select("anomaly_id", "detected_at"), 20, 1000)


@query("l03_page_suppliers", sql(SUP, "SELECT supplier_id, name FROM sup ORDER BY supplier_id LIMIT 50 OFFSET 10"))
def page_suppliers(spark, sf_dir):
    return filters.page_suppliers(b.suppliers(spark, sf_dir).select("supplier_id", "name"), 10, 50)


# The same pages, reached from the last row of the page before instead of by counting rows.

@query("l01_page_documents_after", CHECKS["l01_page_documents"])
def page_documents_after(spark, sf_dir):
    docs = b.documents(spark, sf_dir).select("document_id", "upload_timestamp")
    last = filters.page_documents(docs, limit=100).orderBy("upload_timestamp", F.desc("document_id")).first()
    return filters.page_documents(docs, limit=50, after=(last.upload_timestamp, last.document_id))


@query("l02_page_anomalies_after", CHECKS["l02_page_anomalies"])
def page_anomalies_after(spark, sf_dir):
    rows = b.anomalies(spark, sf_dir).select("anomaly_id", "detected_at")
    last = filters.page_anomalies(rows, limit=20).orderBy("detected_at", F.desc("anomaly_id")).first()
    return filters.page_anomalies(rows, limit=1000, after=(last.detected_at, last.anomaly_id))


@query("l03_page_suppliers_after", CHECKS["l03_page_suppliers"])
def page_suppliers_after(spark, sf_dir):
    rows = b.suppliers(spark, sf_dir).select("supplier_id", "name")
    last = filters.page_suppliers(rows, limit=10).orderBy(F.desc("supplier_id")).first()
    return filters.page_suppliers(rows, limit=50, after=last.supplier_id)


@query("l04_recent", sql(ANO, """
    SELECT anomaly_id, detected_at FROM ano WHERE NOT resolved ORDER BY detected_at DESC, anomaly_id LIMIT 8"""))
def recent(spark, sf_dir):
    return filters.recent(
        b.anomalies(spark, sf_dir).where("not resolved"), 8, "detected_at", "anomaly_id").select(
        "anomaly_id", "detected_at")


@query("l07_dedupe_keep_order", """
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
        generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
    f AS (SELECT doc_id, word, min(pos) AS pos FROM w GROUP BY doc_id, word)
    SELECT doc_id, md5(string_agg(word, ' ' ORDER BY pos)) AS distinct_words FROM f GROUP BY doc_id""")
def dedupe_keep_order(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(
        tx.dedupe_keep_order(F.split("text", " ")), " ").cast("binary")).alias("distinct_words"))


# Set operations

@query("u01_union_checks", sql(DOC, """
    SELECT document_id, CASE WHEN trim(ocr_text) = '' THEN 'ocr_readable,' WHEN ocr_quality_score < 0.25
      THEN 'ocr_quality,' ELSE '' END || 'field_montant_ttc,field_raison_sociale,field_montant_ht' AS rules
    FROM doc"""))
def union_checks(spark, sf_dir):
    docs = b.documents(spark, sf_dir)
    before = rules.bag(rules.readability_check(F.col("ocr_text"), F.col("ocr_quality_score")), rules.CHECKS)
    after = rules.bag(rules.field_checks(F.col("extracted"), F.lit(True), rules.FACTURE_FIELDS), rules.CHECKS)
    return docs.select("document_id", F.array_join(F.concat(before, after)["rule"], ",").alias("rules"))


@query("u02_union_classes", """
    SELECT cast(quality AS varchar) AS label, cast(count(*) AS bigint) AS n, cast(sum(doc_id) AS bigint) AS ids
    FROM labels GROUP BY quality""")
def union_classes(spark, sf_dir):
    rows = b.predictions(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    both = rows.where("label = '0'").unionByName(rows.where("label = '1'"))
    shuffled = ranking.shuffled_rank(both, [], "doc_id", output="position")
    return shuffled.groupBy("label").agg(
        F.count_if(F.col("position") >= 0).alias("n"), F.sum("doc_id").alias("ids"))

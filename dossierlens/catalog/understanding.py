"""Queries over extraction, validation, classification, training, synthetic text and the whole chain."""

from pyspark.sql import functions as F

from dossierlens import schemas
from dossierlens.catalog import bindings as b
from dossierlens.catalog.reference_sql import DOC, PRED, READ_BACK, READ_BACK_RULES, RULES, SUP, sql
from dossierlens.catalog.registry import query
from dossierlens.functions import text as tx
from dossierlens.operators import aggregates, classify, extraction, rules, siblings, synth, training, validation
from dossierlens.plans.processing import dead_letter, process_documents
from dossierlens.sources.writers import curated_record
from dossierlens.storage import scratch_path, stage

KEYS = ["document_id"]


def rendered(spark, sf_dir):
    """Bound documents as text only: the fields are gone and have to be read back."""
    flat = b.documents_flat(spark, sf_dir, spread_rows=True).drop("ocr_text")
    layout = F.pmod(F.col("l_orderkey"), F.lit(synth.LAYOUTS)).cast("int")
    return synth.render_documents(flat, layout).select(
        "document_id", "supplier_id", "original_filename", "mime_type", "file_size_bytes", "upload_timestamp", "status",
        "doc_type", "ocr_text", "ocr_quality_score")


# Extraction: rendered text must give back the bound fields

def _as_read(spark, sf_dir, *types):
    docs = rendered(spark, sf_dir)
    docs = docs.where(F.col("doc_type").isin(list(types))) if types else docs
    return docs.select("document_id", "doc_type", "ocr_text")


def _body(spark, sf_dir, *types):
    return _as_read(spark, sf_dir, *types).select("document_id", "doc_type", tx.fix_numeric_ocr(F.col("ocr_text")).alias("body"))


def _field(name, sql_expr, build, *types, texts=_body):
    where = f"WHERE doc_type IN ({', '.join(repr(t) for t in types)})" if types else ""
    statement = sql(READ_BACK, f"SELECT document_id, {sql_expr} FROM doc {where}")

    def plan(spark, sf_dir):
        return build(texts(spark, sf_dir, *types))
    query(name, statement)(plan)


_field("e01_extract_siret", "siret",
       lambda d: extraction.with_siret(d, "ocr_text").select("document_id", "siret"), texts=_as_read)
_field("e02_extract_siren", "siren",
       lambda d: extraction.with_siret(d, "ocr_text").select(
           "document_id", extraction.extract_siren(F.col("body"), F.col("siret")).alias("siren")), texts=_as_read)
_field("e03_extract_tva_number", "tva_number",
       lambda d: extraction.with_tva_number(d, "ocr_text").select("document_id", "tva_number"), texts=_as_read)
_field("e07_extract_number", "numero_document",
       lambda d: d.select("document_id", extraction.extract_number(
           F.col("body"), F.col("doc_type")).alias("numero_document")), "FACTURE", "DEVIS")
_field("e08_extract_iban", "iban",
       lambda d: d.select("document_id", extraction.extract_iban(F.col("body")).alias("iban")), "RIB")
_field("e09_extract_bic", "bic",
       lambda d: d.select("document_id", extraction.extract_bic(F.col("body")).alias("bic")), "RIB")
_field("e10_extract_bank", "banque",
       lambda d: d.select("document_id", extraction.extract_bank(F.col("body")).alias("banque")), "RIB")
_field("e11_extract_company_name", "raison_sociale",
       lambda d: d.select("document_id", extraction.extract_company_name(F.col("body")).alias("raison_sociale")))
_field("e12_extract_address", "adresse",
       lambda d: d.select("document_id", extraction.extract_address(F.col("body")).alias("adresse")))

EXTRACT_GROUPS = {
    "e04_extract_amounts": (["montant_ht", "montant_tva", "montant_ttc"], ["FACTURE", "DEVIS"]),
    "e05_extract_rate": (["taux_tva"], ["FACTURE", "DEVIS"]),
    "e06_extract_dates": (["date_emission", "date_echeance", "date_expiration"], []),
    "e13_extract_facture": (schemas.EXTRACTED_FIELDS, ["FACTURE"]),
    "e14_extract_devis": (schemas.EXTRACTED_FIELDS, ["DEVIS"]),
    "e15_extract_attestation_siret": (schemas.EXTRACTED_FIELDS, ["SIRET"]),
    "e16_extract_urssaf": (schemas.EXTRACTED_FIELDS, ["URSSAF"]),
    "e17_extract_kbis": (schemas.EXTRACTED_FIELDS, ["KBIS"]),
    "e18_extract_rib": (schemas.EXTRACTED_FIELDS, ["RIB"]),
    "e19_extract_fields": (schemas.EXTRACTED_FIELDS, []),
}


def _extract_plan(fields, types):
    def plan(spark, sf_dir):
        docs = rendered(spark, sf_dir)
        docs = docs.where(F.col("doc_type").isin(types)) if types else docs
        return extraction.extract_fields(docs).select("document_id", *[f"extracted.{c}" for c in fields])
    return plan


for _name, (_fields, _types) in EXTRACT_GROUPS.items():
    _where = f"WHERE doc_type IN ({', '.join(repr(t) for t in _types)})" if _types else ""
    query(_name, sql(READ_BACK, f"SELECT document_id, {', '.join(_fields)} FROM doc {_where}"))(
        _extract_plan(_fields, _types))


# Validation rules

RULE_TYPES = {
    "r02_validate_facture": "FACTURE", "r03_validate_devis": "DEVIS", "r04_validate_urssaf": "URSSAF",
    "r05_validate_kbis": "KBIS", "r06_validate_rib": "RIB", "r07_validate_siret_doc": "SIRET",
}
RULES_SQL = """SELECT document_id, 'check' AS kind, rule AS name, status FROM chk WHERE doc_type = '{t}'
    UNION ALL SELECT document_id, 'finding', type, severity FROM find WHERE doc_type = '{t}'"""


def _rule_rows(validated):
    return validated.checks.select("document_id", F.lit("check").alias("kind"), F.col("rule").alias("name"), "status").unionByName(
        validated.anomalies.select(
            "document_id", F.lit("finding").alias("kind"), F.col("type").alias("name"), F.col("severity").alias("status")))


def judged(spark, sf_dir, doc_type=None):
    """Bound documents with the results of the local rules, written once for the several readers of a validation: what tells the
    documents and their siblings apart, and the results without their wording."""
    docs = b.documents(spark, sf_dir, spread_rows=True)
    results = rules.apply_local_rules(docs if doc_type is None else docs.where(F.col("doc_type") == doc_type), b.AS_OF, brief=True)
    return stage(results.select(
        "document_id", "supplier_id", "original_filename", "doc_type", "status", F.struct("extracted.siret").alias("extracted"), "checks",
        "findings"), "judged")


def _type_rules(doc_type):
    def plan(spark, sf_dir):
        """Only the documents of the type are judged; the others are seen as their siblings."""
        docs, own = b.documents(spark, sf_dir), F.col("doc_type") == doc_type
        compared = [t for t in siblings.TYPES_COMPARED if t == doc_type]
        return _rule_rows(validation.validate_documents(
            judged(spark, sf_dir, doc_type), b.AS_OF, stored=docs.where(~own), types=compared))
    return plan


for _name, _type in RULE_TYPES.items():
    query(_name, sql(*RULES, RULES_SQL.format(t=_type)))(_type_rules(_type))


@query("r01_readability_check", sql(*RULES, """
    SELECT document_id, rule, status FROM chk WHERE rule IN ('ocr_readable', 'ocr_quality')"""))
def readability(spark, sf_dir):
    checks = validation.validate_documents(judged(spark, sf_dir), b.AS_OF).checks
    return checks.where(F.col("rule").isin("ocr_readable", "ocr_quality")).select("document_id", "rule", "status")


@query("r08_validate_unknown", """
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS integer)) AS document_id,
      CASE WHEN l_partkey % 53 = 0 THEN 'ocr_readable' ELSE 'ocr_quality' END AS rule FROM lineitem
    WHERE l_partkey % 53 = 0 OR (l_orderkey % 100) / 100.0 < 0.25""")
def validate_unknown(spark, sf_dir):
    docs = b.documents(spark, sf_dir).withColumn("doc_type", F.lit(schemas.UNKNOWN))
    return validation.validate_documents(docs, b.AS_OF).checks.select("document_id", "rule")


@query("r09_validation_status", sql(*RULES, """
    SELECT doc.document_id, CASE WHEN count(CASE WHEN chk.status = 'error' THEN 1 END) > 0 THEN 'error'
      WHEN count(CASE WHEN chk.status = 'warning' THEN 1 END) > 0 THEN 'warning' ELSE 'ok' END AS validation_status
    FROM doc LEFT JOIN chk USING (document_id) GROUP BY doc.document_id"""))
def validation_status(spark, sf_dir):
    return validation.document_statuses(judged(spark, sf_dir), b.AS_OF)


@query("g09_rollup_document_status", sql(*RULES, """
    SELECT document_id, CASE WHEN count(CASE WHEN status = 'error' THEN 1 END) > 0 THEN 'error'
      WHEN count(CASE WHEN status = 'warning' THEN 1 END) > 0 THEN 'warning' ELSE 'ok' END AS status
    FROM local_chk GROUP BY document_id"""))
def rollup(spark, sf_dir):
    checked = judged(spark, sf_dir).where(F.size("checks") > 0)
    return checked.select("document_id", rules.rollup_document_status(F.col("checks")).alias("status"))


@query("r09_checks", sql(*RULES, "SELECT document_id, rule, status FROM chk"))
def checks(spark, sf_dir):
    return validation.validate_documents(judged(spark, sf_dir), b.AS_OF).checks.select(
        "document_id", "rule", "status")


@query("u03_union_anomalies", sql(*RULES, "SELECT document_id, supplier_id, type, severity FROM find"))
def anomalies(spark, sf_dir):
    return validation.validate_documents(judged(spark, sf_dir), b.AS_OF).anomalies.select(
        "document_id", "supplier_id", "type", "severity")


COMPLIANCE_SQL = """
    SELECT sup.supplier_id, CASE WHEN count(CASE WHEN severity = 'error' THEN 1 END) > 0 THEN 'non_compliant'
      WHEN count(severity) > 0 THEN 'warning' ELSE 'compliant' END AS compliance_status,
      cast(count(severity) AS bigint) AS open_anomalies, cast(count(CASE WHEN severity = 'error' THEN 1 END) AS bigint)
      AS critical_anomalies FROM sup LEFT JOIN find USING (supplier_id) GROUP BY sup.supplier_id"""


def _compliance(spark, sf_dir, found):
    suppliers = b.suppliers(spark, sf_dir)
    status = aggregates.supplier_compliance_status(found, suppliers).select("supplier_id", "compliance_status")
    counts = aggregates.open_anomaly_counts(found)
    zero = F.lit(0).cast("bigint")
    return status.join(counts, "supplier_id", "left").select(
        "supplier_id", "compliance_status", F.coalesce("unresolved", zero).alias("open_anomalies"),
        F.coalesce("critical", zero).alias("critical_anomalies"))


@query("supplier_compliance", sql(SUP, *RULES, COMPLIANCE_SQL))
def supplier_compliance(spark, sf_dir):
    """Which suppliers are not compliant, and by how many findings."""
    found = validation.validate_documents(judged(spark, sf_dir), b.AS_OF).anomalies
    return _compliance(spark, sf_dir, stage(found.select("supplier_id", "severity", "resolved"), "findings"))


# The whole chain from text

@query("p01_process_documents", sql(SUP, *READ_BACK_RULES, COMPLIANCE_SQL))
def process(spark, sf_dir):
    done = process_documents(rendered(spark, sf_dir), b.suppliers(spark, sf_dir), b.AS_OF)
    return _compliance(spark, sf_dir, stage(done.anomalies.select("supplier_id", "severity", "resolved"), "findings"))


STATUSES_SQL = """
    SELECT doc.document_id, doc.doc_type, 'processed' AS status,
      CASE WHEN count(CASE WHEN chk.status = 'error' THEN 1 END) > 0 THEN 'error'
        WHEN count(CASE WHEN chk.status = 'warning' THEN 1 END) > 0 THEN 'warning' ELSE 'ok' END AS validation_status
    FROM doc LEFT JOIN chk USING (document_id) GROUP BY doc.document_id, doc.doc_type"""


# Rows per type that the classifier of the chain is trained on.
MODEL_ROWS = 200


def _statuses(documents):
    return documents.select("document_id", "doc_type", "status", F.col("validation.status").alias("validation_status"))


@query("p01_process_documents_statuses", sql(*READ_BACK_RULES, STATUSES_SQL))
def process_statuses(spark, sf_dir):
    done = process_documents(rendered(spark, sf_dir), b.suppliers(spark, sf_dir), b.AS_OF)
    return _statuses(done.documents)


@query("p01_trained_model_statuses", sql(*READ_BACK_RULES, STATUSES_SQL))
def process_with_a_model(spark, sf_dir):
    """The chain with a classifier that was trained on a bounded sample of the documents, instead of the keyword rules."""
    docs = rendered(spark, sf_dir)
    sample = training.bounded_sample(docs.select("document_id", "ocr_text", F.col("doc_type").alias("label")), "document_id", per_label=MODEL_ROWS)
    model = training.train_forest(sample, "ocr_text")
    return _statuses(process_documents(docs, b.suppliers(spark, sf_dir), b.AS_OF, model=model).documents)


@query("p01_two_runs_statuses", sql(*READ_BACK_RULES, STATUSES_SQL))
def process_statuses_in_two_runs(spark, sf_dir):
    """The documents arrive in two runs; afterwards every document stands as after one run."""
    _, first, second = _two_runs(spark, sf_dir)
    untouched = first.join(second.restated.select("document_id"), "document_id", "left_anti")
    return _statuses(second.documents).unionByName(_statuses(second.restated)).unionByName(_statuses(untouched))


@query("p01_two_runs", sql(SUP, *READ_BACK_RULES, COMPLIANCE_SQL))
def process_in_two_runs(spark, sf_dir):
    _, _, second = _two_runs(spark, sf_dir)
    return _compliance(spark, sf_dir, stage(second.anomalies.select("supplier_id", "severity", "resolved"), "findings"))


def _two_runs(spark, sf_dir):
    """Anomalies and documents after the first run, and the result of the second."""
    docs, suppliers = rendered(spark, sf_dir), b.suppliers(spark, sf_dir)
    late = F.pmod(F.xxhash64("document_id"), F.lit(2)) == 1
    first = process_documents(docs.where(~late), suppliers, b.AS_OF)
    anomalies, documents = stage(first.anomalies, "anomalies"), stage(first.documents, "documents")
    return anomalies, documents, process_documents(
        docs.where(late), suppliers, b.AS_OF, anomalies_so_far=anomalies, documents_so_far=documents)


@query("p02_curated_record", sql(READ_BACK, """
    SELECT document_id, supplier_id, original_filename, doc_type, siret, montant_ttc, ocr_quality_score FROM doc"""))
def curated(spark, sf_dir):
    done = process_documents(rendered(spark, sf_dir), b.suppliers(spark, sf_dir), b.AS_OF)
    return curated_record(done.documents, b.AS_OF).select(
        "document_id", "supplier_id", "original_filename", "doc_type", "extracted.siret", "extracted.montant_ttc",
        "ocr_quality_score")


@query("t06_dead_letter", sql(DOC, """
    SELECT document_id, CASE WHEN trim(ocr_text) = '' THEN 'error' ELSE status END AS status,
      CASE WHEN trim(ocr_text) = '' THEN 'no readable text' END AS error_message FROM doc"""))
def dead_letters(spark, sf_dir):
    docs = b.documents(spark, sf_dir).select("document_id", "status", "ocr_text")
    good, bad = dead_letter(docs)
    return good.unionByName(bad).select("document_id", "status", "error_message")


# Classification

NEUTRAL = {"FIRST": {"the": 2.0, "an": 1.0}, "SECOND": {"ou": 1.5, "eau": 3.0}, "THIRD": {"zq": 4.0, "ent": 2.5}}


def _count(keyword):
    return f"(length(t) - length(replace(t, '{keyword}', ''))) / {len(keyword)}::double"


@query("m01_classify_by_keywords", f"""
    WITH k AS (SELECT doc_id, lower(text) AS t FROM documents),
    s AS (SELECT doc_id, {_count('the')} * 2.0 + {_count('an')} * 1.0 AS a, {_count('ou')} * 1.5 + {_count('eau')} * 3.0
      AS b, {_count('zq')} * 4.0 + {_count('ent')} * 2.5 AS c FROM k)
    SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'UNKNOWN' WHEN a = greatest(a, b, c) THEN 'FIRST'
      WHEN b = greatest(a, b, c) THEN 'SECOND' ELSE 'THIRD' END AS keyword_type,
      CASE WHEN a + b + c > 0 THEN greatest(a, b, c) / (a + b + c) ELSE 0.0 END AS keyword_confidence FROM s""")
def keywords(spark, sf_dir):
    return classify.classify_by_keywords(b.table(spark, sf_dir, "documents"), "text", NEUTRAL).select(
        "doc_id", "keyword_type", "keyword_confidence")


@query("m01_classify_rendered", sql(DOC, "SELECT document_id, doc_type AS keyword_type FROM doc"))
def classify_rendered(spark, sf_dir):
    return classify.classify_by_keywords(rendered(spark, sf_dir)).select("document_id", "keyword_type")


def training_rows(spark, sf_dir):
    """The labelled documents: ``doc_id, text, label`` (the quality of the document)."""
    return b.predictions(spark, sf_dir).select("doc_id", "text", F.col("label").cast("string").alias("label"))


# Normalised text, words and word pairs of the labelled documents, written independently of the Spark plans.
TERMS = r"""
    WITH n AS (SELECT doc_id, quality, lower(text) AS t FROM labels JOIN documents USING (doc_id)),
    a AS (SELECT doc_id, quality, regexp_replace(regexp_replace(regexp_replace(t, '\d[\d\s]*[,.]\d{2}\s*(?:€|eur)', ' montant_eur ', 'g'),
        '\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}', ' date_doc ', 'g'), '\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}', ' date_doc ', 'g') AS t FROM n),
    c AS (SELECT doc_id, quality, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\b\d{14}\b', ' num_siret ', 'g'), '\b\d{9}\b',
        ' num_siren ', 'g'), '\bfr[\s\d]{11,13}\b', ' num_tva ', 'g'), '\bfr\d{2}[\s\d]{23,27}\b', ' num_iban ', 'g') AS t FROM a),
    d AS (SELECT doc_id, quality, regexp_replace(regexp_replace(t, '[━─═]{3,}', ' separateur ', 'g'),
        '[^\p{L}\p{Nd}\p{M}\p{Pc}\s]', ' ', 'g') AS t FROM c),
    w AS (SELECT doc_id, quality, list_filter(string_split_regex(t, '[^\p{L}\p{Nd}\p{M}\p{Pc}]+'), lambda x: regexp_full_match(x, '[a-zA-ZÀ-ÿ_]{3,}'))
        AS words FROM d),
    terms AS (SELECT doc_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS term FROM w),
    counts AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM terms GROUP BY term),
    vocabulary AS (SELECT * FROM counts WHERE df >= 2 AND df <= 0.95::double * (SELECT count(*) FROM n) ORDER BY tf DESC, term LIMIT 8000)
"""


@query("m02_tfidf_features", TERMS + """
    SELECT term, cast(tf AS bigint) AS tf, cast(df AS bigint) AS df, round(ln(((SELECT count(*) FROM n) + 1.0::double) / (df + 1.0::double)), 9) AS idf
    FROM vocabulary""")
def tfidf(spark, sf_dir):
    """The vocabulary with its exact document frequencies and weights; the tests hold the fitted features against it."""
    statistics = training.term_statistics(training_rows(spark, sf_dir))
    return statistics.select("term", "tf", "df", F.round("idf", 9).alias("idf"))


def _split_model(spark, sf_dir):
    rows = stage(training.spread_rows(training.stratified_split(training_rows(spark, sf_dir), "doc_id"), "doc_id"), "split-rows")
    model = training.train_forest(rows.where(~F.col("is_test")))
    return rows, model


# What is exact about a fitted model can be stated: which rows it saw, that probabilities and importances are complete. Its scores
# are recomputed in the tests.

@query("m03_train_forest", """
    SELECT cast(quality AS varchar) AS label, cast(count(*) - round(count(*) * 0.2) AS bigint) AS n_train, cast(round(count(*) * 0.2) AS bigint) AS n_test,
      round(count(*) * 0.2)::double AS probability_sum, true AS scored FROM labels JOIN documents USING (doc_id) GROUP BY quality""")
def train(spark, sf_dir):
    rows, model = _split_model(spark, sf_dir)
    tested = stage(model.predict(rows.where("is_test")).select("doc_id", F.col("label").alias("truth"), "model_type", "model_confidence", F.aggregate(
        F.map_values("model_probabilities"), F.lit(0.0), lambda a, x: a + x).alias("mass")), "tested")
    score = training.evaluate(tested, "truth", "model_type", "model_confidence").first()
    return rows.join(tested, "doc_id", "left").groupBy("label").agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"), F.round(F.sum("mass"), 6).alias("probability_sum"),
        F.lit(0 <= score.f1_macro <= 1 and 0 <= score.accuracy <= 1).alias("scored"))


@query("m04_predict", """
    SELECT doc_id, cast(quality AS varchar) AS label, length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) > 0 AS known_type,
      length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) > 0 AS sure_enough FROM labels JOIN documents USING (doc_id)""")
def predict(spark, sf_dir):
    """Every labelled document by the saved and reloaded model: it gets one of the labels, with at least its share of two."""
    rows, model = _split_model(spark, sf_dir)
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = training.TrainedClassifier.load(path)
    return classify.classify(rows, "text", loaded).select(
        "doc_id", "label", F.col("doc_type").isin("0", "1").alias("known_type"), (F.col("classification_confidence") >= 0.5).alias("sure_enough"))


@query("m04_merge_predictions", """
    WITH p AS (SELECT doc_id, (doc_id * 7 % 100) / 100.0::double AS m, (doc_id * 11 % 100) / 100.0::double AS k,
      doc_id % 5 = 0 AS no_model, doc_id % 13 = 0 AS blank FROM documents)
    SELECT doc_id, CASE WHEN blank THEN 'UNKNOWN' WHEN no_model THEN 'KBIS' WHEN m >= 0.6 THEN 'RIB' WHEN k > m THEN 'KBIS'
      ELSE 'RIB' END AS doc_type, CASE WHEN blank THEN 0.0 WHEN no_model THEN k WHEN m >= 0.6 THEN m WHEN k > m THEN k
      ELSE m END AS classification_confidence FROM p""")
def merge_predictions(spark, sf_dir):
    no_model = F.col("doc_id") % 5 == 0
    empty = F.create_map().cast("map<string,double>")
    rows = b.table(spark, sf_dir, "documents").withColumns({
        "model_type": F.when(~no_model, F.lit("RIB")), "model_probabilities": empty,
        "model_confidence": F.when(~no_model, F.expr("(doc_id * 7 % 100) / 100.0D")),
        "keyword_type": F.lit("KBIS"), "keyword_confidence": F.expr("(doc_id * 11 % 100) / 100.0D"),
        "keyword_probabilities": empty, "text": F.when(F.col("doc_id") % 13 != 0, F.col("text"))})
    return classify.merge_predictions(rows, "text").select("doc_id", "doc_type", "classification_confidence")


METRICS = """
cls AS (SELECT c, count(CASE WHEN label = c THEN 1 END) AS support, count(CASE WHEN prediction = c THEN 1 END) AS predicted,
    count(CASE WHEN label = c AND prediction = c THEN 1 END) AS hits
  FROM pred, (SELECT DISTINCT label AS c FROM pred UNION SELECT DISTINCT prediction FROM pred) k GROUP BY c),
rep AS (SELECT c AS class, CASE WHEN predicted = 0 THEN 0.0 ELSE hits::double / predicted END AS precision,
    CASE WHEN support = 0 THEN 0.0 ELSE hits::double / support END AS recall,
    CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * hits / (support + predicted) END AS f1, support, hits FROM cls)"""


@query("m05_evaluate", sql(PRED, METRICS, """
    SELECT round(sum(hits)::double / sum(support), 9) AS accuracy, round(avg(f1), 9) AS f1_macro,
      round(sum(f1 * support) / sum(support), 9) AS f1_weighted, cast(sum(support) AS bigint) AS n_test,
      round((SELECT avg(confidence) FROM pred WHERE label = prediction), 9) AS avg_confidence_correct FROM rep"""))
def evaluate(spark, sf_dir):
    metrics = training.evaluate(b.predictions(spark, sf_dir), confidence="confidence")
    return metrics.select("n_test", *[
        F.round(c, 9).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted", "avg_confidence_correct")])


@query("m06_per_class_report", sql(PRED, METRICS, """
    SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
      cast(support AS bigint) AS support FROM rep"""))
def per_class_report(spark, sf_dir):
    report = training.per_class_report(b.predictions(spark, sf_dir))
    return report.select("class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("m07_confusion_matrix", sql(PRED, """
    SELECT label, cast(count(CASE WHEN prediction = 0 THEN 1 END) AS bigint) AS predicted_0,
      cast(count(CASE WHEN prediction = 1 THEN 1 END) AS bigint) AS predicted_1 FROM pred GROUP BY label"""))
def confusion_matrix(spark, sf_dir):
    return training.confusion_matrix(b.predictions(spark, sf_dir), [0, 1])


@query("m08_cross_validate", """
    WITH n AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality)
    SELECT cast(fold AS integer) AS fold, cast(sum((n + 4 - fold) // 5) AS bigint) AS n_test, true AS scored FROM n, range(5) r(fold) GROUP BY fold""")
def cross_validate(spark, sf_dir):
    scores = training.cross_validate(training_rows(spark, sf_dir), "doc_id")
    return scores.select("fold", "n_test", F.col("f1_macro").between(0, 1).alias("scored"))


@query("m09_training_verdict", """
    SELECT event_id, CASE WHEN a >= 0.92 AND f >= 0.90 THEN 'EXCELLENT' WHEN a >= 0.85 AND f >= 0.82 THEN 'BON'
      WHEN a >= 0.75 THEN 'ACCEPTABLE' ELSE 'INSUFFISANT' END AS verdict
    FROM (SELECT event_id, (event_id % 101) / 100.0::double AS a, (event_id * 7 % 101) / 100.0::double AS f FROM events)""")
def training_verdict(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select("event_id", training.training_verdict(
        F.expr("(event_id % 101) / 100.0D"), F.expr("(event_id * 7 % 101) / 100.0D")).alias("verdict"))


@query("l06_top_features", "SELECT cast(20 AS bigint) AS n_top, true AS in_order, 1.0::double AS importance_sum")
def top_features(spark, sf_dir):
    """The twenty most important terms, checked against the importances of the whole vocabulary."""
    rows, model = _split_model(spark, sf_dir)
    every, top = model.feature_importances(spark), model.top_features(spark, 20)
    total = every.agg(F.round(F.sum("importance"), 6).alias("importance_sum"))
    least = top.agg(F.count("*").alias("n_top"), F.min("importance").alias("least"))
    above = every.join(least, F.col("importance") > F.col("least")).agg((F.count("*") < 20).alias("in_order"))
    return least.select("n_top").join(above).join(total)


# Synthetic text

CERTIFICATES_SQL = sql(DOC, r"""
    , f AS (SELECT *, 'Raison sociale : ' || raison_sociale AS l_name, 'Adresse : ' || adresse || '.' AS l_address,
        'SIRET : ' || siret || ' (siège)' AS l_siret,
        substr(date_emission, 9, 2) || '/' || substr(date_emission, 6, 2) || '/' || substr(date_emission, 1, 4) AS emis,
        substr(date_expiration, 9, 2) || '/' || substr(date_expiration, 6, 2) || '/' || substr(date_expiration, 1, 4) AS fin,
        concat_ws(' ', substr(iban, 1, 4), substr(iban, 5, 5), substr(iban, 10, 5), substr(iban, 15, 11),
          substr(iban, 26, 2)) AS spaced FROM doc WHERE doc_type IN ('SIRET', 'URSSAF', 'KBIS', 'RIB'))
    SELECT document_id, CASE doc_type
      WHEN 'SIRET' THEN concat_ws(chr(10), 'ATTESTATION DE SITUATION AU RÉPERTOIRE SIRENE',
        'Délivrée par l''INSEE d''après le répertoire national des entreprises', l_name, l_address,
        'Numéro SIRET : ' || siret || ' (siège)', 'Établissement actif, code APE attribué.', 'Date d''édition : ' || emis)
      WHEN 'URSSAF' THEN concat_ws(chr(10), 'ATTESTATION DE VIGILANCE - URSSAF', l_name, l_address, l_siret,
        'Cotisations sociales et contributions patronales en règle.',
        'Code de la sécurité sociale, contrôle sur net-entreprises.', 'Date d''émission : ' || emis,
        'Valable jusqu''au : ' || fin)
      WHEN 'KBIS' THEN concat_ws(chr(10), 'EXTRAIT KBIS - REGISTRE DU COMMERCE', l_name, l_address, l_siret,
        'N° TVA : ' || tva_number, 'Immatriculation au RCS, forme juridique et capital social déclarés.',
        'Date d''édition : ' || emis, 'Certifié par le greffier du tribunal de commerce, gérant inscrit.')
      ELSE concat_ws(chr(10), 'RELEVÉ D''IDENTITÉ BANCAIRE', 'Titulaire du compte ci-dessous.', l_name, l_address, l_siret,
        'IBAN : ' || spaced || ' ;', 'BIC : ' || bic || ' ;', 'Domiciliation : ' || banque,
        'Code guichet et clé RIB repris pour tout virement ou prélèvement.') END AS ocr_text FROM f""")
# Four types with one layout, and the three layouts of invoices and of quotes.
RENDERED_SQL = f"SELECT * FROM ({CERTIFICATES_SQL}) UNION ALL SELECT * FROM (" + sql(DOC, r"""
    , f AS (SELECT *, l_orderkey % 3 AS layout, 'Raison sociale : ' || raison_sociale AS l_name, adresse || '.' AS l_address,
        'SIRET : ' || siret || ' (siège)' AS l_siret, 'N° TVA : ' || tva_number AS l_tva,
        cast(cast(montant_ht AS decimal(18,2)) AS varchar) || ' €' AS ht, cast(cast(montant_tva AS decimal(18,2)) AS varchar) || ' €' AS tva,
        cast(cast(montant_ttc AS decimal(18,2)) AS varchar) || ' €' AS ttc, cast(taux_tva AS varchar) AS rate,
        substr(date_emission, 9, 2) || '/' || substr(date_emission, 6, 2) || '/' || substr(date_emission, 1, 4) AS emis,
        substr(date_echeance, 9, 2) || '/' || substr(date_echeance, 6, 2) || '/' || substr(date_echeance, 1, 4) AS du,
        substr(date_expiration, 9, 2) || '/' || substr(date_expiration, 6, 2) || '/' || substr(date_expiration, 1, 4) AS fin,
        'Pénalités de retard exigibles sans rappel, indemnité forfaitaire due pour toute facture impayée.' AS end_f,
        'Prestations proposées sous réserve d''acceptation, acompte de 30 % à la commande.' || chr(10)
          || 'Bon pour accord, devis non contractuel avant signature.' AS end_d
      FROM doc WHERE doc_type IN ('FACTURE', 'DEVIS'))
    SELECT document_id, CASE
      WHEN doc_type = 'FACTURE' AND layout = 0 THEN concat_ws(chr(10), raison_sociale, l_address, l_siret, l_tva,
        'FACTURE N° ' || numero_document, 'Date d''émission : ' || emis, 'Date d''échéance : ' || du,
        'Vendeur et acheteur désignés au contrat, mode de règlement : virement.', 'Total HT : ' || ht,
        'TVA ' || rate || '% : ' || tva, 'TOTAL TTC : ' || ttc, end_f)
      WHEN doc_type = 'FACTURE' AND layout = 1 THEN concat_ws(chr(10), 'FACTURE', 'N° de facture : ' || numero_document,
        'Date de facturation : ' || emis, 'Date de paiement : ' || du, l_name, l_address, l_siret, l_tva,
        'Montant HT : ' || ht, 'Taux de TVA ' || rate || ' %', 'Montant TVA : ' || tva, 'Montant TTC : ' || ttc, end_f)
      WHEN doc_type = 'FACTURE' THEN concat_ws(chr(10), 'DOCUMENT DE FACTURATION', 'Ref. facture : ' || numero_document,
        'Émis le ' || emis, 'Payable le ' || du, l_name, l_address, l_siret, l_tva,
        'Règlement de la présente facture sans escompte.', 'Montant HT : ' || ht, 'dont TVA : ' || tva,
        'Net à payer : ' || ttc, end_f)
      WHEN layout = 0 THEN concat_ws(chr(10), raison_sociale, l_address, l_siret, l_tva, 'DEVIS N° ' || numero_document,
        'Date d''établissement : ' || emis, 'Valable jusqu''au : ' || fin, 'Sous-total HT : ' || ht,
        'TVA ' || rate || '% : ' || tva, 'Total TTC : ' || ttc, end_d)
      WHEN layout = 1 THEN concat_ws(chr(10), 'PROPOSITION COMMERCIALE', 'Offre n° ' || numero_document, 'Fait le ' || emis,
        'Date de validité : ' || fin, l_name, l_address, l_siret, l_tva, 'Total HT : ' || ht, 'Taux de TVA ' || rate || ' %',
        'Montant TVA : ' || tva, 'Total TTC : ' || ttc, end_d)
      ELSE concat_ws(chr(10), 'OFFRE DE SERVICES', 'N° du devis : ' || numero_document,
        'Date du document' || chr(10) || 'Date de document : ' || emis, 'Expire le ' || fin, l_name, l_address, l_siret, l_tva,
        'Base HT : ' || ht, 'Montant TVA : ' || tva, 'Total général : ' || ttc, end_d) END AS ocr_text FROM f""") + ")"


# Both names stand for the whole table; the first one used to leave two types out.
@query("y01_render_documents", RENDERED_SQL)
@query("y05_render_all_documents", RENDERED_SQL)
def render_all_documents(spark, sf_dir):
    return rendered(spark, sf_dir).select("document_id", "ocr_text")

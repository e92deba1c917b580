"""The same bindings as common table expressions for the check engine, written independently of the Spark plans."""

from dossierlens.catalog.bindings import FAULTS


def siret_sql(base: str) -> str:
    def digit(i):
        return f"cast(substr({base}, {i}, 1) as integer)"

    parts = []
    for i in range(1, 14):
        parts.append(f"(case when {digit(i)} > 4 then 2*{digit(i)}-9 else 2*{digit(i)} end)" if i % 2 else digit(i))
    return f"{base} || cast((10 - ({' + '.join(parts)}) % 10) % 10 as varchar)"


SUP = f"""
sup0 AS (
  SELECT s.*, n.n_name, cast(100000000 + 7 * s_suppkey AS varchar) AS siren
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
sup AS (
  SELECT s_suppkey, 'sup-' || s_suppkey AS supplier_id, s_name AS name, {siret_sql("(siren || '0001')")} AS siret, siren,
    'FR' || lpad(cast((12 + 3 * (cast(siren AS bigint) % 97)) % 97 AS varchar), 2, '0') || siren AS tva_number,
    n_name AS address,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN 'no mail'
      ELSE 'contact' || s_suppkey || '@example.fr' END AS email,
    CASE s_suppkey % 4 WHEN 0 THEN 'compliant' WHEN 1 THEN 'warning' WHEN 2 THEN 'non_compliant' ELSE 'pending' END
      AS compliance_status
  FROM sup0)"""

DOC = f"""
doc0 AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS integer)) AS document_id,
    'sup-' || l_suppkey AS supplier_id, l_orderkey, l_partkey, l_suppkey, l_linenumber,
    cast(l_quantity AS integer) AS qty, l_shipdate AS upload_timestamp, cast(l_shipdate AS date) AS shipped,
    CASE l_partkey % 6 WHEN 0 THEN 'FACTURE' WHEN 1 THEN 'DEVIS' WHEN 2 THEN 'SIRET' WHEN 3 THEN 'URSSAF'
      WHEN 4 THEN 'KBIS' ELSE 'RIB' END AS doc_type,
    CASE l_partkey % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'preprocessing' WHEN 2 THEN 'ocr_done'
      WHEN 3 THEN 'classified' WHEN 4 THEN 'extracted' WHEN 5 THEN 'validated' WHEN 7 THEN 'error'
      ELSE 'processed' END AS status,
    CASE l_linenumber % 4 WHEN 0 THEN 200 WHEN 1 THEN 100 WHEN 2 THEN 55 ELSE 21 END AS rate10,
    (cast(round(l_extendedprice * 100) AS bigint) * (100 - cast(round(l_discount * 100) AS integer)) + 50) // 100 AS ht_c,
    cast(100000000 + 7 * (l_suppkey + CASE WHEN l_partkey % {FAULTS['mismatch']} = 0 THEN 1 ELSE 0 END) AS varchar)
      || '0001' AS shown_base,
    cast(100000000 + 7 * l_suppkey AS varchar) AS own_siren
  FROM lineitem),
doc1 AS (
  SELECT *, (ht_c * rate10 + 500) // 1000 AS tva_c, {siret_sql("shown_base")} AS shown_siret,
    '30006' || lpad(cast(l_suppkey AS varchar), 5, '0') || lpad(cast(l_partkey AS varchar), 11, '0')
      || lpad(cast(l_orderkey % 97 AS varchar), 2, '0') AS bban,
    doc_type IN ('FACTURE', 'DEVIS') AND l_partkey % {FAULTS['amounts']} <> 0 AS has_amounts,
    l_partkey % {FAULTS['dates']} <> 0 AS has_dates
  FROM doc0),
doc2 AS (
  SELECT *, CASE WHEN l_partkey % {FAULTS['luhn']} = 0 THEN substr(shown_siret, 1, 13)
      || cast((cast(substr(shown_siret, 14, 1) AS integer) + 1) % 10 AS varchar) ELSE shown_siret END AS siret,
    ht_c + tva_c + CASE WHEN l_partkey % {FAULTS['gross']} = 0 THEN 5000 + ht_c // 50 ELSE 0 END AS ttc_c
  FROM doc1),
doc AS (
  SELECT document_id, supplier_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, upload_timestamp, status, doc_type,
    lower(doc_type) || '-' || document_id || '.pdf' AS original_filename,
    siret, substr(siret, 1, 9) AS siren,
    CASE WHEN doc_type IN ('FACTURE', 'DEVIS', 'KBIS') THEN 'FR'
      || lpad(cast((12 + 3 * (cast(own_siren AS bigint) % 97)) % 97 AS varchar), 2, '0') || own_siren END AS tva_number,
    CASE WHEN has_amounts THEN ht_c / 100.0::double END AS montant_ht,
    CASE WHEN has_amounts THEN tva_c / 100.0::double END AS montant_tva,
    CASE WHEN has_amounts THEN ttc_c / 100.0::double END AS montant_ttc,
    CASE WHEN has_amounts THEN rate10 / 10.0::double END AS taux_tva,
    CASE WHEN has_dates AND doc_type <> 'RIB' THEN strftime(shipped, '%Y-%m-%d') END AS date_emission,
    CASE WHEN has_dates AND doc_type = 'FACTURE' THEN strftime(shipped + 30, '%Y-%m-%d')
      WHEN has_dates AND doc_type = 'DEVIS' THEN strftime(shipped + 4 * qty, '%Y-%m-%d') END AS date_echeance,
    CASE WHEN has_dates AND doc_type IN ('DEVIS', 'URSSAF') THEN strftime(shipped + 4 * qty, '%Y-%m-%d')
      WHEN has_dates AND doc_type = 'KBIS' THEN strftime(shipped + 90, '%Y-%m-%d') END AS date_expiration,
    CASE doc_type WHEN 'FACTURE' THEN 'FACT-' || l_orderkey || '-' || l_linenumber
      WHEN 'DEVIS' THEN 'DEV-' || l_orderkey || '-' || l_linenumber END AS numero_document,
    'SOCIETE ' || translate(lpad(cast(l_suppkey AS varchar), 5, '0'), '0123456789', 'ACDEFGHJKM') || ' SARL'
      AS raison_sociale,
    CASE WHEN doc_type = 'RIB' THEN 'FR' || CASE WHEN l_partkey % {FAULTS['iban']} = 0 THEN '00' ELSE
      lpad(cast(98 - cast((bban || '152700')::hugeint % 97 AS integer) AS varchar), 2, '0') END || bban END AS iban,
    CASE WHEN doc_type = 'RIB' AND l_partkey % {FAULTS['bic']} <> 0 THEN CASE l_suppkey % 4 WHEN 0 THEN 'BNPAFRPP'
      WHEN 1 THEN 'SOGEFRPP' WHEN 2 THEN 'AGRIFRPP' ELSE 'CEPAFRPP751' END END AS bic,
    CASE WHEN doc_type = 'RIB' THEN CASE l_suppkey % 4 WHEN 0 THEN 'Bnp Paribas' WHEN 1 THEN 'Société Générale'
      WHEN 2 THEN 'Crédit Agricole' ELSE 'Banque Populaire' END END AS banque,
    (1 + l_suppkey % 99) || ' RUE DES LILAS, ' || (75001 + l_suppkey % 20) || ' PARIS' AS adresse,
    CASE WHEN l_partkey % {FAULTS['blank']} = 0 THEN '   ' ELSE 'texte lu' END AS ocr_text,
    (l_orderkey % 100) / 100.0::double AS ocr_quality_score, 1000 + l_orderkey AS file_size_bytes
  FROM doc2)"""

ANO = """
ano AS (
  SELECT event_id, 'an-' || event_id AS anomaly_id, 'sup-' || user_id AS supplier_id, 'doc-' || user_id AS document_id,
    CASE event_id % 7 WHEN 0 THEN 'SIRET_MISMATCH' WHEN 1 THEN 'TVA_INCOHERENCE' WHEN 2 THEN 'DATE_EXPIRED'
      WHEN 3 THEN 'MISSING_FIELD' WHEN 4 THEN 'FORMAT_ERROR' WHEN 5 THEN 'KBIS_EXPIRED' ELSE 'URSSAF_EXPIRED' END AS type,
    CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
    event_type || ' ' || event_id AS message,
    CASE WHEN event_id % 5 <> 0 THEN DATE '2000-05-25' + cast(event_id % 60 AS integer) END AS details_date,
    ts AS detected_at, event_id % 4 = 0 AS resolved
  FROM events)"""

EVT = """
evt AS (
  SELECT 'doc-' || user_id AS document_id, event_id, ts,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'ocr_done' WHEN 'click' THEN 'classified'
      WHEN 'purchase' THEN 'processed' ELSE 'error' END AS status
  FROM events)"""

PAGE = """
page AS (
  SELECT 'conv-' || conv_id AS document_id, turn AS page, text, ((conv_id + turn) % 100) / 100.0::double AS confidence,
    'config-' || (turn % 4) AS ocr_config,
    CASE WHEN (conv_id + turn) % 9 = 0 THEN 'trocr' ELSE 'strategy-' || (turn % 3) END AS preprocessing_strategy
  FROM conversations)"""

PRED = """
pred AS (
  SELECT l.doc_id, cast(l.quality AS integer) AS label, cast(d.n_chars >= 200 AS integer) AS prediction,
    (l.doc_id % 100) / 100.0::double AS confidence
  FROM labels l JOIN documents d USING (doc_id))"""

# Days are whole calendar days before 2000-06-01, one less than the difference because the check hour is 09:00.
AS_OF_DATE = "DATE '2000-06-01'"
DAYS_UNTIL = "(cast({} AS date) - DATE '2000-06-01' - 1)"
DAYS_SINCE = "(DATE '2000-06-01' - cast({} AS date))"


def sql(*ctes_and_query) -> str:
    *ctes, query = ctes_and_query
    return f"WITH {', '.join(ctes)} {query}" if ctes else query


# Verdicts of the rules, restated on the bound fields.
JUDGED = f"""
judged AS (
  SELECT doc.*, siret = {siret_sql("substr(siret, 1, 13)")} AS siret_ok,
    montant_ht IS NULL OR montant_tva IS NULL OR montant_ttc IS NULL AS amounts_missing,
    greatest(1.0::double, abs(montant_ttc) * 0.005::double) AS tol,
    abs(round(montant_ht + montant_tva, 2) - montant_ttc) AS sum_gap,
    abs(round(montant_ht * taux_tva / 100, 2) - montant_tva) AS rate_gap,
    {DAYS_UNTIL.format("date_expiration")} AS days_left, {DAYS_SINCE.format("date_emission")} AS age,
    (substr(iban, 5) || '1527' || substr(iban, 3, 2))::hugeint % 97 = 1 AS iban_ok
  FROM doc),
j AS (
  SELECT *, amounts_missing OR (sum_gap <= tol AND rate_gap <= tol) AS tva_ok,
    CASE WHEN date_expiration IS NULL THEN CASE WHEN doc_type IN ('URSSAF', 'KBIS') THEN 'warning' ELSE 'ok' END
      WHEN days_left < 0 THEN 'error' WHEN days_left <= 30 THEN 'warning' ELSE 'ok' END AS expiry_status,
    CASE WHEN date_expiration IS NULL THEN CASE WHEN doc_type IN ('URSSAF', 'KBIS') THEN 'MISSING_FIELD' ELSE '' END
      WHEN days_left < 0 THEN CASE doc_type WHEN 'URSSAF' THEN 'URSSAF_EXPIRED' WHEN 'KBIS' THEN 'KBIS_EXPIRED'
        ELSE 'DATE_EXPIRED' END
      WHEN days_left <= 30 THEN 'DATE_EXPIRED' ELSE '' END AS expiry_type,
    CASE WHEN date_emission IS NULL THEN 'warning' WHEN age > 90 THEN 'error' WHEN 90 - age <= 14 THEN 'warning'
      ELSE 'ok' END AS kbis_status
  FROM judged)"""

MISMATCH = """
pairs AS (
  SELECT a.document_id, a.supplier_id, a.siret, b.document_id AS sibling_document_id, b.siret AS sibling_siret
  FROM doc a JOIN doc b ON a.supplier_id = b.supplier_id AND a.document_id <> b.document_id AND a.siret <> b.siret
  WHERE a.doc_type <> 'DEVIS' AND b.status IN ('extracted', 'validated', 'processed')),
mis AS (
  SELECT document_id, supplier_id, siret, cast(count(*) AS bigint) AS n_mismatch,
    cast(count(DISTINCT sibling_siret) AS bigint) AS n_other_sirets, min(sibling_document_id) AS related_document_id
  FROM pairs GROUP BY document_id, supplier_id, siret)"""

LOCAL_CHECKS = """
local_chk AS (
  SELECT document_id, doc_type, 'ocr_readable' AS rule, 'error' AS status FROM j WHERE trim(ocr_text) = ''
  UNION ALL SELECT document_id, doc_type, 'ocr_quality', 'warning' FROM j
    WHERE trim(ocr_text) <> '' AND ocr_quality_score < 0.25
  UNION ALL SELECT document_id, doc_type, 'siret_format', CASE WHEN siret_ok THEN 'ok' WHEN doc_type = 'FACTURE'
    THEN 'warning' ELSE 'error' END FROM j WHERE doc_type IN ('FACTURE', 'URSSAF', 'KBIS', 'SIRET')
  UNION ALL SELECT document_id, doc_type, 'tva_coherence', CASE WHEN tva_ok THEN 'ok' ELSE 'warning' END FROM j
    WHERE doc_type IN ('FACTURE', 'DEVIS')
      AND (montant_ht IS NOT NULL OR montant_tva IS NOT NULL OR montant_ttc IS NOT NULL)
  UNION ALL SELECT document_id, doc_type, 'field_montant_ttc', CASE WHEN montant_ttc IS NOT NULL THEN 'ok'
    WHEN doc_type = 'FACTURE' THEN 'warning' ELSE 'info' END FROM j WHERE doc_type IN ('FACTURE', 'DEVIS')
  UNION ALL SELECT document_id, doc_type, 'field_raison_sociale', CASE WHEN raison_sociale IS NOT NULL THEN 'ok'
    WHEN doc_type = 'FACTURE' THEN 'warning' ELSE 'info' END FROM j WHERE doc_type IN ('FACTURE', 'DEVIS')
  UNION ALL SELECT document_id, doc_type, 'field_montant_ht', CASE WHEN montant_ht IS NOT NULL THEN 'ok' ELSE 'info' END
    FROM j WHERE doc_type = 'FACTURE'
  UNION ALL SELECT document_id, doc_type, 'field_date_expiration', CASE WHEN date_expiration IS NOT NULL THEN 'ok'
    ELSE 'info' END FROM j WHERE doc_type = 'DEVIS'
  UNION ALL SELECT document_id, doc_type, 'devis_expiration', expiry_status FROM j
    WHERE doc_type = 'DEVIS' AND date_expiration IS NOT NULL
  UNION ALL SELECT document_id, doc_type, 'urssaf_expiration', expiry_status FROM j WHERE doc_type = 'URSSAF'
  UNION ALL SELECT document_id, doc_type, 'field_date_expiration', 'error' FROM j
    WHERE doc_type = 'URSSAF' AND date_expiration IS NULL
  UNION ALL SELECT document_id, doc_type, 'kbis_age', kbis_status FROM j WHERE doc_type = 'KBIS'
  UNION ALL SELECT document_id, doc_type, 'iban_format', CASE WHEN iban_ok THEN 'ok' ELSE 'warning' END FROM j
    WHERE doc_type = 'RIB'
  UNION ALL SELECT document_id, doc_type, 'bic_present', CASE WHEN bic IS NOT NULL THEN 'ok' ELSE 'info' END FROM j
    WHERE doc_type = 'RIB'),
chk AS (
  SELECT * FROM local_chk
  UNION ALL SELECT mis.document_id, doc_type, 'siret_consistency', 'error' FROM mis JOIN doc USING (document_id))"""

LOCAL_FINDINGS = """
local_find AS (
  SELECT document_id, supplier_id, doc_type, 'FORMAT_ERROR' AS type,
    CASE doc_type WHEN 'FACTURE' THEN 'warning' ELSE 'error' END AS severity FROM j
    WHERE doc_type IN ('FACTURE', 'SIRET') AND NOT siret_ok
  UNION ALL SELECT document_id, supplier_id, doc_type, 'TVA_INCOHERENCE', 'warning' FROM j
    WHERE doc_type IN ('FACTURE', 'DEVIS') AND NOT tva_ok
  UNION ALL SELECT document_id, supplier_id, doc_type, expiry_type, 'warning' FROM j
    WHERE doc_type = 'DEVIS' AND date_expiration IS NOT NULL AND expiry_status = 'error'
  UNION ALL SELECT document_id, supplier_id, doc_type, expiry_type, expiry_status FROM j
    WHERE doc_type = 'URSSAF' AND expiry_status IN ('error', 'warning')
  UNION ALL SELECT document_id, supplier_id, doc_type, 'MISSING_FIELD', 'error' FROM j
    WHERE doc_type = 'URSSAF' AND date_expiration IS NULL
  UNION ALL SELECT document_id, supplier_id, doc_type, 'KBIS_EXPIRED', kbis_status FROM j
    WHERE doc_type = 'KBIS' AND kbis_status IN ('error', 'warning')
  UNION ALL SELECT document_id, supplier_id, doc_type, 'FORMAT_ERROR', 'warning' FROM j
    WHERE doc_type = 'RIB' AND NOT iban_ok),
find AS (
  SELECT * FROM local_find
  UNION ALL SELECT mis.document_id, mis.supplier_id, doc_type, 'SIRET_MISMATCH', 'error'
    FROM mis JOIN doc USING (document_id))"""

RULES = [DOC, JUDGED, MISMATCH, LOCAL_CHECKS, LOCAL_FINDINGS]


# Documents as they come back from their rendered text. In layout 0 the VAT amount is not captured but deduced from the
# gross amount, when the rate that follows from it is plausible.
_RATES = (20.0, 10.0, 8.5, 5.5, 2.1)
_PLAUSIBLE = " OR ".join(
    f"abs(round(montant_ttc - montant_ht, 2) * 100 / montant_ht - {r}::double) <= 2.0::double" for r in _RATES)
READ_BACK = DOC.replace("doc AS (\n", "doc_bound AS (\n") + f""",
doc AS (
  SELECT * REPLACE (
    CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN montant_ttc > montant_ht AND ({_PLAUSIBLE})
      THEN round(montant_ttc - montant_ht, 2) END ELSE montant_tva END AS montant_tva,
    'lu' AS ocr_text, 'extracted' AS status) FROM doc_bound)"""
READ_BACK_RULES = [READ_BACK, *RULES[1:]]

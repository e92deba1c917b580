"""The scalar rules called as SQL functions, one query per group; the checks are those of the DataFrame queries where they exist."""

from dossierlens.catalog import bindings as b
from dossierlens.catalog.reference_sql import DOC, sql
from dossierlens.catalog.registry import CHECKS, query
from dossierlens.catalog.scalars import IBAN_CASE, SIRET_CASE
from dossierlens.functions import sql as functions_sql


def _run(spark, statement, docs):
    functions_sql.register(spark, b.AS_OF)
    return spark.sql(statement, docs=docs)


def _joined(key, *names):
    """The checks of several queries side by side."""
    first, *others = [f"({CHECKS[name]}) {name}" for name in names]
    return first + "".join(f" JOIN {other} USING ({key})" for other in others)


@query("sql_identifier_functions", f"""
    SELECT document_id, n01_siret_luhn.ok AS luhn, message, n03_iban_format.ok AS iban, check_digits, n04_tva_number.ok AS tva,
      n10_bic_valid.ok AS bic, siren_tva, siret AS cleaned
    FROM {_joined("document_id", "n01_siret_luhn", "n02_siret_format", "n03_iban_format", "n09_iban_check_digits", "n04_tva_number", "n10_bic_valid")}
    JOIN ({sql(DOC, '''SELECT document_id, siret,
      'FR' || lpad(cast((12 + 3 * (siren::bigint % 97)) % 97 AS varchar), 2, '0') || siren AS siren_tva FROM doc''')}) own USING (document_id)""")
def identifiers(spark, sf_dir):
    return _run(spark, f"""
        SELECT document_id, siret_luhn({SIRET_CASE}) AS luhn, siret_format({SIRET_CASE}).message AS message, iban_format({IBAN_CASE}).ok AS iban,
          iban_check_digits(substr(iban, 5, 23)) AS check_digits,
          tva_number(CASE l_orderkey % 4 WHEN 0 THEN tva_number WHEN 1 THEN lower(tva_number) WHEN 2 THEN 'FR00' || substr(tva_number, 5)
            ELSE 'DE' || substr(tva_number, 3) END, siren).ok AS tva,
          bic_valid(CASE l_orderkey % 3 WHEN 0 THEN bic WHEN 1 THEN lower(bic) ELSE bic || 'X' END) AS bic, siren_to_tva(siren) AS siren_tva,
          clean_number(substr(siret, 1, 3) || ' ' || substr(siret, 4, 3) || '.' || substr(siret, 7, 3) || '-' || substr(siret, 10)) AS cleaned
        FROM {{docs}}""", b.documents_flat(spark, sf_dir))


@query("sql_amount_functions", f"""
    SELECT document_id, ok, sum_fails, plausible, montant_ht AS parsed, taux_tva AS snapped
    FROM {_joined("document_id", "n05_tva_coherence", "n16_rate_plausible")}
    JOIN ({sql(DOC, "SELECT document_id, montant_ht, taux_tva FROM doc")}) own USING (document_id)""")
def amounts(spark, sf_dir):
    return _run(spark, """
        SELECT document_id, verdict.ok AS ok, verdict.details['expected_ttc'] IS NOT NULL AS sum_fails,
          rate_plausible(montant_ht, montant_ttc - montant_ht) AS plausible,
          parse_amount(replace(CAST(CAST(montant_ht AS DECIMAL(18,2)) AS STRING), '.', ',')) AS parsed, snap_rate(taux_tva + 0.3D, 0.5D) AS snapped
        FROM (SELECT *, tva_coherence(montant_ht, montant_tva, montant_ttc, taux_tva) AS verdict FROM {docs})""", b.documents_flat(spark, sf_dir))


@query("sql_date_functions", f"""
    SELECT document_id, n06_expiration_status.status AS expiry, anomaly_type, n07_kbis_age_status.status AS kbis, issued, date_emission AS parsed
    FROM {_joined("document_id", "n06_expiration_status", "n07_kbis_age_status")}
    JOIN ({sql(DOC, "SELECT document_id, cast(date_emission AS date) AS issued, date_emission FROM doc")}) own USING (document_id)""")
def dates(spark, sf_dir):
    return _run(spark, """
        SELECT document_id, expiration_status(date_expiration, doc_type).status AS expiry,
          expiration_status(date_expiration, doc_type).anomaly_type AS anomaly_type, kbis_age_status(date_emission).status AS kbis,
          parse_iso(date_emission) AS issued,
          parse_date(substr(date_emission, 9, 2) || '/' || substr(date_emission, 6, 2) || '/' || substr(date_emission, 1, 4)) AS parsed
        FROM {docs}""", b.documents_flat(spark, sf_dir))


@query("sql_text_functions", CHECKS["n15_fix_numeric_ocr"])
def text(spark, sf_dir):
    return _run(spark, """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, raw, fix_numeric_ocr(raw) AS fixed
        FROM (SELECT *, concat('REF:', l_orderkey + 100000000, '.SOIBZlo:', l_linenumber) AS raw FROM {docs})""", b.table(spark, sf_dir, "lineitem"))

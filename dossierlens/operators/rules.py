"""Validation rules that look at one document: checks and findings as arrays of structs.

Arrays are concatenations of zero- or one-element arrays. That keeps the order of the rules and stays inside generated
code, where a filter over an array of optional structs would not.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dossierlens import schemas
from dossierlens.functions import amounts, dates, identifiers, text as tx

# Thresholds and wording.
OCR_QUALITY_THRESHOLD = 0.25
MSG_OCR_EMPTY = "OCR vide — document illisible, corrompu ou pipeline non terminé"
MSG_OCR_WEAK = "Qualité OCR faible (%.0f%%) — champs extraits peu fiables"
MSG_SIRET_NOT_FOUND = "SIRET absent — mention légale obligatoire non trouvée par OCR"
MSG_TVA_OK = "Cohérence TVA OK"
MSG_FOUND = "%s extrait"
MSG_NOT_FOUND = "%s non extrait par OCR"
MSG_URSSAF_DATE = "Date d'expiration URSSAF manquante"
MSG_URSSAF_DATE_ANOMALY = "Attestation URSSAF %s : date d'expiration manquante"
MSG_BIC_OK = "BIC présent"
MSG_BIC_ABSENT = "BIC absent du RIB"
MSG_FACTURE_FORMAT = "Facture %s : %s"
MSG_RIB_FORMAT = "RIB %s : %s"
MSG_SIRET_FORMAT = "Attestation SIRET %s : %s"
FACTURE_FIELDS = [
    ("montant_ttc", "Montant TTC", "warning"),
    ("raison_sociale", "Raison sociale vendeur", "warning"),
    ("montant_ht", "Montant HT", "info"),
]
DEVIS_FIELDS = [
    ("montant_ttc", "Montant TTC", "info"),
    ("raison_sociale", "Raison sociale émetteur", "info"),
    ("date_expiration", "Date de validité du devis", "info"),
]

CHECKS = T.ArrayType(schemas.CHECK)
FINDINGS = T.ArrayType(schemas.FINDING)
# What tells how a document stands, without the wording.
BRIEF_CHECKS = T.ArrayType(T.StructType([schemas.CHECK[name] for name in ("rule", "status")]))
BRIEF_FINDINGS = T.ArrayType(T.StructType([schemas.FINDING[name] for name in ("type", "severity")]))


def details(**values) -> Column:
    """``map<string,string>`` of the given columns; no values give an empty map."""
    entries = [part for key, value in values.items() for part in (F.lit(key), value.cast("string"))]
    return (F.create_map(*entries) if entries else F.create_map()).cast(schemas.DETAILS)


def make_check(rule: str, status: Column, message: Column, info: Column = None) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), status.alias("status"), message.alias("message"),
        (details() if info is None else info).alias("details"),
    )


def pass_or_fail(rule: str, ok: Column, message_ok: Column, message_fail: Column, severity: str,
                 info: Column = None) -> Column:
    return make_check(
        rule, F.when(ok, F.lit("ok")).otherwise(F.lit(severity)),
        F.when(ok, message_ok).otherwise(message_fail), info,
    )


def make_anomaly(kind: Column, severity: Column, message: Column, info: Column, related: Column = None) -> Column:
    return F.struct(
        kind.alias("type"), severity.alias("severity"), message.alias("message"), info.alias("details"),
        (F.lit(None).cast("string") if related is None else related).alias("related_document_id"),
    )


def bag(entries, dtype) -> Column:
    """Concatenate ``(condition, struct)`` pairs; a pair whose condition does not hold adds nothing. Only the fields that ``dtype``
    names are kept, so that the others are not computed."""
    empty, names = F.array().cast(dtype), dtype.elementType.names
    return F.concat(*[
        F.when(when, F.array(F.struct(*[item[n].alias(n) for n in names])).cast(dtype)).otherwise(empty) for when, item in entries])


def unworded(verdict: Column, *kept: str) -> Column:
    """The named fields of a verdict, its message and details left empty."""
    return F.struct(*[verdict[n].alias(n) for n in kept], F.lit(None).cast("string").alias("message"),
                    F.lit(None).cast(schemas.DETAILS).alias("details"))


def readability_check(text: Column, score: Column) -> list:
    blank = tx.is_blank(text)
    weak = ~blank & F.coalesce(score < OCR_QUALITY_THRESHOLD, F.lit(False))
    return [
        (blank, make_check("ocr_readable", F.lit("error"), F.lit(MSG_OCR_EMPTY))),
        (weak, make_check("ocr_quality", F.lit("warning"), F.format_string(MSG_OCR_WEAK, score * 100),
                          details(ocr_quality_score=score))),
    ]


def field_checks(extracted: Column, applies: Column, fields: list) -> list:
    return [
        (applies, pass_or_fail(
            f"field_{name}", extracted[name].isNotNull(), F.lit(MSG_FOUND % label), F.lit(MSG_NOT_FOUND % label),
            severity, details(field=F.lit(name))))
        for name, label, severity in fields
    ]


def apply_local_rules(df: DataFrame, as_of: datetime, check_col: str = "checks",
                      finding_col: str = "findings", brief: bool = False) -> DataFrame:
    """Add the checks and findings every document earns on its own; ``brief`` ones are rule and status, type and severity, for readers
    that need no wording.

    Input columns: ``doc_type, original_filename, ocr_text, ocr_quality_score, extracted``. The per-value verdicts are
    computed in a first projection and used several times in the second one.
    """
    doc_type = F.col("doc_type")
    name = F.col("original_filename")
    x = F.col("extracted")

    def told(verdict, *kept):
        return unworded(verdict, *kept) if brief else verdict

    judged = df.withColumns({
        "_siret": told(identifiers.siret_format(x["siret"]), "ok"),
        "_tva": F.when(doc_type.isin("FACTURE", "DEVIS"), told(amounts.tva_coherence(
            x["montant_ht"], x["montant_tva"], x["montant_ttc"], x["taux_tva"]), "ok")),
        "_expiry": F.when(
            doc_type.isin("DEVIS", "URSSAF"),
            told(dates.expiration_status(x["date_expiration"], doc_type, as_of), "status", "anomaly_type")),
        "_kbis": F.when(doc_type == "KBIS", told(dates.kbis_age_status(x["date_emission"], as_of), "status")),
        "_iban": F.when(doc_type == "RIB", told(identifiers.iban_format(x["iban"]), "ok")),
    })
    siret, tva, expiry, kbis, iban = (F.col(c) for c in ("_siret", "_tva", "_expiry", "_kbis", "_iban"))

    def of(*types):
        return F.coalesce(doc_type.isin(*types), F.lit(False))

    facture, devis, urssaf, is_kbis, rib, siret_doc = (
        of(t) for t in ("FACTURE", "DEVIS", "URSSAF", "KBIS", "RIB", "SIRET"))
    no_siret = identifiers.absent(x["siret"])
    any_amount = x["montant_ht"].isNotNull() | x["montant_tva"].isNotNull() | x["montant_ttc"].isNotNull()
    no_expiry = identifiers.absent(x["date_expiration"])
    siret_info = details(siret=x["siret"])
    expiry_info = details(date_expiration=x["date_expiration"])
    emission_info = details(date_emission=x["date_emission"])
    ok_siret = F.lit(identifiers.SIRET_OK)

    checks = readability_check(F.col("ocr_text"), F.col("ocr_quality_score")) + [
        (facture & no_siret, make_check("siret_format", F.lit("warning"), F.lit(MSG_SIRET_NOT_FOUND), siret_info)),
        (facture & ~no_siret, pass_or_fail(
            "siret_format", siret["ok"], ok_siret, siret["message"], "warning", siret_info)),
        (urssaf | is_kbis | siret_doc, pass_or_fail(
            "siret_format", siret["ok"], ok_siret, siret["message"], "error", siret_info)),
        ((facture | devis) & any_amount, pass_or_fail(
            "tva_coherence", tva["ok"], F.lit(MSG_TVA_OK), tva["message"], "warning", tva["details"])),
        *field_checks(x, facture, FACTURE_FIELDS),
        *field_checks(x, devis, DEVIS_FIELDS),
        (devis & ~no_expiry, make_check("devis_expiration", expiry["status"], expiry["message"], expiry_info)),
        (urssaf, make_check("urssaf_expiration", expiry["status"], expiry["message"], expiry_info)),
        (urssaf & no_expiry, make_check("field_date_expiration", F.lit("error"), F.lit(MSG_URSSAF_DATE))),
        (is_kbis, make_check("kbis_age", kbis["status"], kbis["message"], emission_info)),
        (rib, pass_or_fail("iban_format", iban["ok"], F.lit(identifiers.IBAN_OK), iban["message"], "warning",
                           details(iban=x["iban"]))),
        (rib, pass_or_fail("bic_present", x["bic"].isNotNull(), F.lit(MSG_BIC_OK), F.lit(MSG_BIC_ABSENT), "info")),
    ]

    def anomaly(kind, severity, message, info):
        return make_anomaly(
            F.lit(kind) if isinstance(kind, str) else kind,
            F.lit(severity) if isinstance(severity, str) else severity, message, info)

    bad_siret = ~no_siret & ~siret["ok"]
    findings = [
        (facture & bad_siret, anomaly(
            "FORMAT_ERROR", "warning", F.format_string(MSG_FACTURE_FORMAT, name, siret["message"]), siret_info)),
        (siret_doc & bad_siret, anomaly(
            "FORMAT_ERROR", "error", F.format_string(MSG_SIRET_FORMAT, name, siret["message"]), siret_info)),
        ((facture | devis) & ~F.coalesce(tva["ok"], F.lit(True)), anomaly(
            "TVA_INCOHERENCE", "warning", tva["message"], tva["details"])),
        (devis & ~no_expiry & (expiry["status"] == "error"), anomaly(
            expiry["anomaly_type"], "warning", expiry["message"], expiry_info)),
        (urssaf & expiry["status"].isin("error", "warning"), anomaly(
            expiry["anomaly_type"], expiry["status"], expiry["message"], expiry_info)),
        (urssaf & no_expiry, anomaly(
            "MISSING_FIELD", "error", F.format_string(MSG_URSSAF_DATE_ANOMALY, name),
            details(field=F.lit("date_expiration")))),
        (is_kbis & kbis["status"].isin("error", "warning"), anomaly(
            "KBIS_EXPIRED", kbis["status"], kbis["message"], emission_info)),
        (rib & ~identifiers.absent(x["iban"]) & ~iban["ok"], anomaly(
            "FORMAT_ERROR", "warning", F.format_string(MSG_RIB_FORMAT, name, iban["message"]),
            details(iban=x["iban"]))),
    ]
    kept = df.drop(check_col, finding_col).columns
    return judged.select(*kept, bag(checks, BRIEF_CHECKS if brief else CHECKS).alias(check_col),
                         bag(findings, BRIEF_FINDINGS if brief else FINDINGS).alias(finding_col))


def rollup_document_status(checks: Column) -> Column:
    """Worst status of the checks; ``info`` does not count."""
    return (
        F.when(F.array_contains(checks["status"], "error"), F.lit("error"))
        .when(F.array_contains(checks["status"], "warning"), F.lit("warning"))
        .otherwise(F.lit("ok"))
    )

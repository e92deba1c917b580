"""Explicit table schemas and string domains.

Every reader passes one of these schemas, so no job ever infers types from data and Parquet column pruning works on the
nested fields as well.
"""

from pyspark.sql import types as T

# String domains of the data model.
DOC_TYPES = ["FACTURE", "DEVIS", "SIRET", "URSSAF", "KBIS", "RIB"]
UNKNOWN = "UNKNOWN"
DOCUMENT_STATUSES = [
    "pending", "preprocessing", "ocr_done", "classified", "extracted", "validated", "processed", "error",
]
OPEN_STATUSES = DOCUMENT_STATUSES[:6]
SIBLING_STATUSES = ["extracted", "validated", "processed"]
ANOMALY_TYPES = [
    "SIRET_MISMATCH", "TVA_INCOHERENCE", "DATE_EXPIRED", "MISSING_FIELD", "FORMAT_ERROR", "KBIS_EXPIRED",
    "URSSAF_EXPIRED",
]
EXPIRY_TYPES = ["DATE_EXPIRED", "KBIS_EXPIRED", "URSSAF_EXPIRED"]
SEVERITIES = ["error", "warning", "info"]

_STR = T.StringType()
_DBL = T.DoubleType()
_TS = T.TimestampType()
DETAILS = T.MapType(_STR, _STR, True)


def _struct(**fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


EXTRACTED = _struct(
    siret=_STR, siren=_STR, tva_number=_STR,
    montant_ht=_DBL, montant_tva=_DBL, montant_ttc=_DBL, taux_tva=_DBL,
    date_emission=_STR, date_echeance=_STR, date_expiration=_STR,
    numero_document=_STR, raison_sociale=_STR, iban=_STR, bic=_STR, banque=_STR, adresse=_STR,
)
EXTRACTED_FIELDS = EXTRACTED.fieldNames()
AMOUNT_FIELDS = ["montant_ht", "montant_tva", "montant_ttc", "taux_tva"]

CHECK = _struct(rule=_STR, status=_STR, message=_STR, details=DETAILS)
VALIDATION = _struct(status=_STR, checks=T.ArrayType(CHECK, True), validated_at=_TS)

SUPPLIER = _struct(
    supplier_id=_STR, name=_STR, siret=_STR, siren=_STR, tva_number=_STR, address=_STR, email=_STR, phone=_STR,
    notes=_STR, created_at=_TS, updated_at=_TS, compliance_status=_STR,
)

DOCUMENT = _struct(
    document_id=_STR, supplier_id=_STR, filename=_STR, original_filename=_STR, mime_type=_STR,
    file_size_bytes=T.LongType(), upload_timestamp=_TS, status=_STR, zone=_STR,
    raw_path=_STR, clean_path=_STR, curated_path=_STR,
    doc_type=_STR, classification_confidence=_DBL, classification_probabilities=T.MapType(_STR, _DBL, True),
    ocr_text=_STR, ocr_quality_score=_DBL, extracted=EXTRACTED, validation=VALIDATION,
    processing_duration_ms=T.LongType(), error_message=_STR, uploaded_by=_STR, seed_key=_STR,
)

ANOMALY = _struct(
    anomaly_id=_STR, supplier_id=_STR, document_id=_STR, related_document_id=_STR, type=_STR, severity=_STR,
    message=_STR, details=DETAILS, detected_at=_TS, resolved=T.BooleanType(), resolved_at=_TS,
)

# One finding before it gets an id and a detection time.
FINDING = _struct(type=_STR, severity=_STR, message=_STR, details=DETAILS, related_document_id=_STR)

OCR_WORD = _struct(
    document_id=_STR, page=T.IntegerType(), pass_no=T.IntegerType(), block_num=T.IntegerType(),
    par_num=T.IntegerType(), line_num=T.IntegerType(), word_num=T.IntegerType(), text=_STR, conf=_DBL,
)

IMAGE_QUALITY = _struct(
    document_id=_STR, page=T.IntegerType(), blur_score=_DBL, contrast_score=_DBL, brightness=_DBL,
    noise_score=_DBL, skew_angle=_DBL, width=T.IntegerType(), height=T.IntegerType(),
)

TRAINING_ROW = _struct(text=_STR, label=_STR)

# Nested answer of the company registry.
REGISTRY = T.StructType([
    T.StructField("etablissements", T.ArrayType(_struct(
        siret=_STR,
        siren=_STR,
        uniteLegale=_struct(
            denominationUniteLegale=_STR, denominationUsuelle1UniteLegale=_STR,
            nomUniteLegale=_STR, prenom1UniteLegale=_STR,
        ),
        adresseEtablissement=_struct(
            numeroVoieEtablissement=_STR, typeVoieEtablissement=_STR, libelleVoieEtablissement=_STR,
            codePostalEtablissement=_STR, libelleCommuneEtablissement=_STR,
        ),
    ))),
])

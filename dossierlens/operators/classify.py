"""Keyword classification of document text and its combination with a trained model.

The lexicon is a constant of the plan: a few literal expressions per row, no join and no shuffle.
"""

from pyspark.sql import Column, DataFrame, functions as F

from dossierlens import schemas
from dossierlens.functions import text as tx

# Weighted keywords per type, counted as substrings.
LEXICON = {
    "FACTURE": {
        "facture": 4.0, "numéro de facture": 5.0, "fact-": 3.0, "date d'échéance": 3.5, "date d'émission": 2.0,
        "pénalités de retard": 4.0, "indemnité forfaitaire": 4.0, "mode de règlement": 3.0, "escompte": 2.5,
        "vendeur": 2.0, "acheteur": 2.0,
    },
    "DEVIS": {
        "devis": 4.0, "proposition commerciale": 5.0, "valable jusqu": 4.0, "bon pour accord": 4.5,
        "référence devis": 5.0, "devis-": 3.0, "acompte de": 3.0, "validité": 2.5, "prestations proposées": 4.0,
        "acceptation": 2.5, "non contractuel": 3.0, "sous réserve": 2.0,
    },
    "SIRET": {
        "attestation de situation": 4.0, "répertoire sirene": 5.0, "répertoire national": 4.0, "insee": 3.0,
        "numéro siret": 3.0, "attestation siret": 5.0, "annuaire-entreprises": 3.0, "code ape": 2.0,
        "date de création": 1.5, "établissement actif": 3.0,
    },
    "URSSAF": {
        "urssaf": 5.0, "attestation de vigilance": 5.0, "cotisations sociales": 4.0,
        "contributions patronales": 3.5, "l.243-15": 4.0, "net-entreprises": 3.0,
        "code de la sécurité sociale": 3.0, "en règle": 2.5, "régularité de situation": 3.0,
        "sécurité sociale": 2.0,
    },
    "KBIS": {
        "extrait kbis": 5.0, "tribunal de commerce": 4.5, "registre du commerce": 4.5, "immatriculation": 3.0,
        "capital social": 3.0, "gérant": 2.5, "rcs": 3.0, "greffier": 3.5, "forme juridique": 2.5,
        "siège social": 2.0, "date d'immatriculation": 3.0, "3 mois": 2.0,
    },
    "RIB": {
        "relevé d'identité bancaire": 5.0, "rib": 3.0, "iban": 4.0, "bic": 3.0, "swift": 2.5,
        "domiciliation": 3.0, "code banque": 4.0, "code guichet": 4.0, "clé rib": 4.0,
        "titulaire du compte": 3.5, "virement": 1.5, "prélèvement": 1.5,
    },
}
CONFIDENCE_THRESHOLD = 0.6


def occurrences(text: Column, keyword: str) -> Column:
    """Non-overlapping substring count. Most keywords are absent, and ``contains`` settles that without a copy; sizes in bytes are
    known, whereas characters have to be counted."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(keyword), F.lit("")))
    return F.when(F.contains(text, F.lit(keyword)), removed / F.lit(len(keyword.encode()))).otherwise(F.lit(0.0))


def keyword_score(text: Column, keywords: dict) -> Column:
    return sum((occurrences(text, keyword) * weight for keyword, weight in keywords.items()), F.lit(0.0))


def classify_by_keywords(df: DataFrame, text_col: str = "ocr_text", lexicon: dict = None,
                         prefix: str = "keyword") -> DataFrame:
    """Add ``<prefix>_type``, ``<prefix>_confidence`` and ``<prefix>_probabilities``.

    The score of a type is divided by the text length in the original definition; that divisor is common to all types and
    cancels when scores become shares. Ties go to the type listed first.
    """
    lexicon = LEXICON if lexicon is None else lexicon
    types = list(lexicon)
    scored = df.withColumn("_lower", F.lower(F.coalesce(F.col(text_col), F.lit("")))).withColumns(
        {f"_score_{i}": keyword_score(F.col("_lower"), lexicon[t]) for i, t in enumerate(types)}
    )
    scores = [F.col(f"_score_{i}") for i in range(len(types))]
    totals = scored.withColumns({
        "_total": sum(scores[1:], scores[0]),
        "_best": F.greatest(*scores) if len(scores) > 1 else scores[0],
    })
    total, best = F.col("_total"), F.col("_best")
    winner = F.when(best == 0, F.lit(schemas.UNKNOWN))
    for t, score in zip(types, scores):
        winner = winner.when(score == best, F.lit(t))
    shares = [F.when(total > 0, score / total).otherwise(F.lit(0.0)) for score in scores]
    return totals.select(
        *df.columns,
        winner.alias(f"{prefix}_type"),
        F.when(total > 0, best / total).otherwise(F.lit(0.0)).alias(f"{prefix}_confidence"),
        F.create_map(*[part for t, share in zip(types, shares) for part in (F.lit(t), share)])
        .alias(f"{prefix}_probabilities"),
    )


def merge_predictions(df: DataFrame, text_col: str = "ocr_text", threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Choose between ``model_*`` and ``keyword_*`` columns.

    A confident model wins; below the threshold the keywords win only if they are strictly more certain; without a model
    the keywords decide; blank text is unknown.
    """
    has_model = F.col("model_type").isNotNull()
    use_model = has_model & (
        (F.col("model_confidence") >= threshold) | (F.col("keyword_confidence") <= F.col("model_confidence")))
    blank = tx.is_blank(F.col(text_col))
    nothing = F.create_map(*[part for t in schemas.DOC_TYPES for part in (F.lit(t), F.lit(0.0))])

    def pick(name, empty):
        return F.when(blank, empty).when(use_model, F.col(f"model_{name}")).otherwise(F.col(f"keyword_{name}"))

    return df.withColumns({
        "doc_type": pick("type", F.lit(schemas.UNKNOWN)),
        "classification_confidence": pick("confidence", F.lit(0.0)),
        "classification_probabilities": pick("probabilities", nothing),
    })


def classify(df: DataFrame, text_col: str = "ocr_text", model=None, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Add ``doc_type, classification_confidence, classification_probabilities``; ``model`` comes from ``training``."""
    keep = [c for c in df.columns
            if c not in ("doc_type", "classification_confidence", "classification_probabilities")]
    scored = classify_by_keywords(df.select(*keep), text_col)
    if model is None:
        scored = scored.withColumns({
            "model_type": F.lit(None).cast("string"),
            "model_confidence": F.lit(None).cast("double"),
            "model_probabilities": F.lit(None).cast("map<string,double>"),
        })
    else:
        scored = model.predict(scored, text_col)
    return merge_predictions(scored, text_col, threshold).select(
        *keep, "doc_type", "classification_confidence", "classification_probabilities")

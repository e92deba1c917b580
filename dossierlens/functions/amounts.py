"""Amounts and VAT rates as column expressions."""

from functools import reduce

from pyspark.sql import Column, functions as F

# French legal rates and tolerances.
LEGAL_RATES = [20.0, 10.0, 8.5, 5.5, 2.1]
TEXT_RATE_TOLERANCE = 0.5
COMPUTED_RATE_TOLERANCE = 1.0
PLAUSIBLE_RATE_TOLERANCE = 2.0
# Amounts from here on are taken for misread numbers where the reference behaviour is asked for.
AMOUNT_LIMIT = 10_000_000.0
COHERENCE_ABS_TOLERANCE = 1.0
COHERENCE_REL_TOLERANCE = 0.005
# Wording of the findings.
TVA_UNVERIFIABLE = "Vérification impossible (champs manquants)"
TVA_SUM = "Incohérence HT+TVA≠TTC : %s + %s = %s ≠ %s (écart %.2f€)"
TVA_RATE = "Incohérence HT×taux≠TVA : %s × %s%% = %s ≠ %s (écart %.2f€)"
TVA_COHERENT = "Cohérence TVA vérifiée"


def parse_amount(raw: Column, limit: float | None = None) -> Column:
    """``1 234,56`` / ``1.234,56`` / ``1234.56`` to a positive double, rounded to cents.

    Every amount is accepted; with a ``limit`` (``AMOUNT_LIMIT``) those from it on are taken for misread numbers and become NULL.
    """
    compact = F.regexp_replace(raw, r"(?U)[\s ]", "")
    dotted = F.when(
        compact.contains(",") & compact.contains("."),
        F.replace(F.replace(compact, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
    ).otherwise(F.replace(compact, F.lit(","), F.lit(".")))
    value = dotted.try_cast("double")
    return F.when((value > 0) if limit is None else (value > 0) & (value < limit), F.round(value, 2))


def split_amounts(ht: Column, rate: Column) -> Column:
    """VAT and gross amount of a net amount, rounded to cents in decimal arithmetic so that halves round up exactly."""
    net = ht.cast("decimal(18,2)")
    tva = F.round(net * rate.cast("decimal(6,2)") / 100, 2)
    return F.struct(tva.cast("double").alias("tva"), (net + tva).cast("double").alias("ttc"))


def rate_plausible(ht: Column, tva: Column) -> Column:
    implied = F.try_divide(tva * 100, ht)
    near = reduce(
        lambda a, b: a | b, [F.abs(implied - rate) <= PLAUSIBLE_RATE_TOLERANCE for rate in LEGAL_RATES]
    )
    return F.coalesce((ht > 0) & (tva > 0) & near, F.lit(False))


def nearest_legal_rate(rate: Column, tolerance: float) -> Column:
    """The rate itself when legal, otherwise the first legal rate within the tolerance, otherwise NULL."""
    within = reduce(
        lambda chain, legal: chain.when(F.abs(rate - legal) <= tolerance, F.lit(legal)),
        LEGAL_RATES,
        F.when(rate.isin(LEGAL_RATES), rate),
    )
    return within


def snap_rate(rate: Column, tolerance: float, keep_unmatched: bool) -> Column:
    snapped = nearest_legal_rate(rate, tolerance)
    return F.coalesce(snapped, rate) if keep_unmatched else snapped


def plain_number(amount: Column) -> Column:
    """Shortest decimal text of an amount, without exponent."""
    return F.when(F.abs(amount) < AMOUNT_LIMIT, amount.cast("string")).otherwise(
        F.regexp_replace(amount.cast("decimal(24,2)").cast("string"), "0$", "")
    )


def tva_coherence(ht: Column, tva: Column, ttc: Column, rate: Column,
                  abs_tol: float = COHERENCE_ABS_TOLERANCE, rel_tol: float = COHERENCE_REL_TOLERANCE) -> Column:
    """``struct<ok, message, details>``: net + VAT = gross, then net × rate = VAT, both within the same tolerance."""
    tolerance = F.greatest(F.lit(abs_tol), F.abs(ttc) * rel_tol)
    expected_ttc = F.round(ht + tva, 2)
    gap = F.abs(expected_ttc - ttc)
    expected_tva = F.round(ht * rate / 100, 2)
    gap_tva = F.abs(expected_tva - tva)

    missing = ht.isNull() | tva.isNull() | ttc.isNull()
    sum_fails = ~missing & (gap > tolerance)
    rate_fails = ~missing & ~sum_fails & F.coalesce((rate != 0) & (ht != 0) & (gap_tva > tolerance), F.lit(False))

    text = plain_number
    message = (
        F.when(missing, F.lit(TVA_UNVERIFIABLE))
        .when(sum_fails, F.format_string(TVA_SUM, text(ht), text(tva), text(expected_ttc), text(ttc), gap))
        .when(rate_fails, F.format_string(TVA_RATE, text(ht), text(rate), text(expected_tva), text(tva), gap_tva))
        .otherwise(F.lit(TVA_COHERENT))
    )
    inputs = [F.lit("ht"), text(ht), F.lit("tva"), text(tva), F.lit("ttc"), text(ttc), F.lit("taux"), text(rate)]
    details = (
        F.when(sum_fails, F.create_map(
            *inputs, F.lit("ecart"), text(F.round(gap, 2)), F.lit("expected_ttc"), text(expected_ttc)))
        .when(rate_fails, F.create_map(
            *inputs, F.lit("expected_tva"), text(expected_tva), F.lit("ecart_tva"), text(F.round(gap_tva, 2))))
        .otherwise(F.create_map(*inputs))
    )
    return F.struct(
        (~sum_fails & ~rate_fails).alias("ok"), message.alias("message"), details.alias("details")
    )

"""Date parsing and expiry arithmetic as column expressions.

Every operator that depends on the current time takes ``as_of`` (a UTC datetime), so a re-run gives the same rows. Day
counts come from calendar dates plus the time of day of ``as_of``; they do not depend on the session time zone.
"""

from datetime import datetime

from pyspark.sql import Column, functions as F

# Limits of the business rules.
PLAUSIBLE_YEARS = (1990, 2050)
EXPIRY_WARNING_DAYS = 30
KBIS_VALIDITY_DAYS = 90
KBIS_WARNING_DAYS = 14
# Month words. The first list is understood by the reference behaviour, the second is French.
STRICT_MONTHS = {"jan": 1, "mar": 3, "jun": 6, "jul": 7, "sep": 9, "oct": 10, "nov": 11}
FRENCH_MONTHS = {
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "jan": 1, "fév": 2, "mar": 3, "avr": 4, "jun": 6, "jul": 7, "aoû": 8, "sep": 9, "oct": 10, "nov": 11, "déc": 12,
}
# Wording of the findings.
EXPIRY_MISSING = "Date d'expiration non trouvée pour %s"
EXPIRY_NOT_NEEDED = "Pas de date d'expiration requise"
EXPIRED_SINCE = "Document %s expiré depuis %d jours (%s)"
EXPIRES_IN = "Document %s expire dans %d jours (%s)"
VALID_UNTIL = "Document %s valide jusqu'au %s (%d jours restants)"
KBIS_MISSING = "Date d'émission Kbis non trouvée, impossibilité de vérifier la validité légale"
KBIS_TOO_OLD = "Kbis trop ancien : émis il y a %d jours (limite légale : 90 jours)"
KBIS_SOON = "Kbis bientôt invalide : %d jours restants (limite 90 jours)"
KBIS_VALID = "Kbis valide (%d jours, limite 90 jours)"


def parse_iso(text: Column) -> Column:
    """Strict year-month-day text to a date, anything else NULL."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), text.try_cast("date"))


def _plausible(date: Column, years=None) -> Column:
    """ISO text of a date of the given years; others count as misread and become NULL. None accepts every year."""
    return date.cast("string") if years is None else F.when(F.year(date).between(*years), date.cast("string"))


def _rearranged(text: Column, pattern: str, order: str) -> Column:
    return F.regexp_replace(text, pattern, order).try_cast("date")


def parse_numeric_date(raw: Column, strict_reference: bool = True, years=None) -> Column:
    """``d/m/y`` or ``y-m-d`` text to ISO text. The preferred order of the parts comes first; the other one only gives a
    date when the preferred month exceeds twelve. Every year is accepted, or those of ``years`` (``PLAUSIBLE_YEARS``)."""
    dmy = r"^\D*(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\D*$"
    ymd = r"^\D*(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})\D*$"
    if strict_reference:
        year_first = F.coalesce(_rearranged(raw, ymd, "$1-$3-$2"), _rearranged(raw, ymd, "$1-$2-$3"))
    else:
        year_first = _rearranged(raw, ymd, "$1-$2-$3")
    return _plausible(
        F.when(raw.rlike(ymd), year_first)
        .when(raw.rlike(dmy), F.coalesce(_rearranged(raw, dmy, "$3-$2-$1"), _rearranged(raw, dmy, "$3-$1-$2"))), years)


def parse_worded_date(raw: Column, strict_reference: bool = True, years=None) -> Column:
    """``d month y`` text to ISO text."""
    worded = r"(?U)^\s*(\d{1,2})\s+(\p{L}+)\.?\s+(\d{4})\s*$"
    months = STRICT_MONTHS if strict_reference else FRENCH_MONTHS
    table = F.create_map(*[F.lit(part) for item in months.items() for part in (item[0], f"$3-{item[1]}-$1")])
    order = F.try_element_at(table, F.lower(F.regexp_extract(raw, worded, 2)))
    return _plausible(F.regexp_replace(raw, F.lit(worded), order).try_cast("date"), years)


def parse_date(raw: Column, strict_reference: bool = True, years=None) -> Column:
    """Free-form date text to ISO text.

    Day comes first; day and month swap when the month would exceed twelve. With ``strict_reference`` a year-first date
    whose last part is at most twelve is read year-day-month and only abbreviations shared with English are month words;
    otherwise year-first means year-month-day and French month words are understood.
    """
    return F.coalesce(parse_numeric_date(raw, strict_reference, years), parse_worded_date(raw, strict_reference, years))


def days_until(date: Column, as_of: datetime) -> Column:
    """Whole days from ``as_of`` to the midnight that starts ``date``, rounded down: −1 for a date that is today."""
    started = 0 if as_of.time() == datetime.min.time() else 1
    return F.datediff(date, F.lit(as_of.date())) - F.lit(started)


def full_days_until(date: Column, as_of: datetime) -> Column:
    """Completed days between ``as_of`` and ``date``, cut towards zero: 0 for a date that is today."""
    started = 0 if as_of.time() == datetime.min.time() else 1
    days = F.datediff(date, F.lit(as_of.date()))
    return F.when(days > 0, days - started).otherwise(days)


def days_since(date: Column, as_of: datetime) -> Column:
    return F.datediff(F.lit(as_of.date()), date)


def expiration_status(text: Column, doc_type: Column, as_of: datetime,
                      warning_days: int = EXPIRY_WARNING_DAYS) -> Column:
    """``struct<status, message, anomaly_type>`` of an expiry date."""
    date = parse_iso(text)
    days = days_until(date, as_of)
    required = doc_type.isin("URSSAF", "KBIS")
    expired_type = (
        F.when(doc_type == "URSSAF", F.lit("URSSAF_EXPIRED"))
        .when(doc_type == "KBIS", F.lit("KBIS_EXPIRED"))
        .otherwise(F.lit("DATE_EXPIRED"))
    )
    status = (
        F.when(date.isNull(), F.when(required, F.lit("warning")).otherwise(F.lit("ok")))
        .when(days < 0, F.lit("error"))
        .when(days <= warning_days, F.lit("warning"))
        .otherwise(F.lit("ok"))
    )
    message = (
        F.when(date.isNull(), F.when(required, F.format_string(EXPIRY_MISSING, doc_type))
               .otherwise(F.lit(EXPIRY_NOT_NEEDED)))
        .when(days < 0, F.format_string(EXPIRED_SINCE, doc_type, F.abs(days), text))
        .when(days <= warning_days, F.format_string(EXPIRES_IN, doc_type, days, text))
        .otherwise(F.format_string(VALID_UNTIL, doc_type, text, days))
    )
    anomaly_type = (
        F.when(date.isNull(), F.when(required, F.lit("MISSING_FIELD")).otherwise(F.lit("")))
        .when(days < 0, expired_type)
        .when(days <= warning_days, F.lit("DATE_EXPIRED"))
        .otherwise(F.lit(""))
    )
    return F.struct(status.alias("status"), message.alias("message"), anomaly_type.alias("anomaly_type"))


def kbis_age_status(text: Column, as_of: datetime) -> Column:
    """``struct<status, message>`` of a company extract that is legally valid for ninety days after issue."""
    date = parse_iso(text)
    age = days_since(date, as_of)
    remaining = F.lit(KBIS_VALIDITY_DAYS) - age
    status = (
        F.when(date.isNull(), F.lit("warning"))
        .when(age > KBIS_VALIDITY_DAYS, F.lit("error"))
        .when(remaining <= KBIS_WARNING_DAYS, F.lit("warning"))
        .otherwise(F.lit("ok"))
    )
    message = (
        F.when(date.isNull(), F.lit(KBIS_MISSING))
        .when(age > KBIS_VALIDITY_DAYS, F.format_string(KBIS_TOO_OLD, age))
        .when(remaining <= KBIS_WARNING_DAYS, F.format_string(KBIS_SOON, remaining))
        .otherwise(F.format_string(KBIS_VALID, age))
    )
    return F.struct(status.alias("status"), message.alias("message"))


def urgency(days_left: Column) -> Column:
    return (
        F.when(days_left < 0, F.lit("Expiré"))
        .when(days_left <= 7, F.lit("Critique"))
        .when(days_left <= 14, F.lit("Urgent"))
        .when(days_left <= 30, F.lit("Attention"))
        .otherwise(F.lit("OK"))
    )


def days_left_label(days_left: Column) -> Column:
    return (
        F.when(days_left < 0, F.concat(F.lit("Expiré il y a "), F.abs(days_left).cast("string"), F.lit("j")))
        .when(days_left == 0, F.lit("Expire aujourd'hui"))
        .otherwise(F.concat(F.lit("J-"), days_left.cast("string")))
    )


def expiry_bucket(days_left: Column) -> Column:
    """Bucket of the expiry report; a missing day count is far in the future."""
    days = F.coalesce(days_left, F.lit(999))
    return (
        F.when(days < 0, F.lit("expired"))
        .when(days <= 7, F.lit("critical"))
        .when(days <= 14, F.lit("urgent"))
        .otherwise(F.lit("warning"))
    )


def details_date(details: Column) -> Column:
    """First expiry date named in a finding's details, whatever spelling of the key was written."""
    return F.coalesce(
        *[F.try_element_at(details, F.lit(key)) for key in ("expiration_date", "expiry_date", "date_expiration")]
    )

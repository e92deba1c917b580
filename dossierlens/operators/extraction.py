"""Field extraction: document text to the ``extracted`` struct.

One projection serves all document types. Each field is a column that is gated by the type, so a row only pays for the
patterns of its own type and the table is scanned once. Intermediate columns are kept in separate projections on purpose:
the optimizer does not merge a projection whose expensive outputs are used more than once, so each pattern runs once.
"""

from pyspark.sql import Column, DataFrame, functions as F

from dossierlens import schemas
from dossierlens.functions import amounts, dates, identifiers, text as tx

# The patterns below decide which characters of a document become a field.
AMOUNT = r"([\d\s]{1,10}[,.]?\d{0,2})\s*(?:€|EUR|euros?)?"
DATE = r"(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4}|\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2})"
HT = tx.led("tTmMsS\u017FbBnNhH", r"(?:total\s+ht|montant\s+ht|sous.?total\s+ht|base\s+ht|net\s+ht|\bht\s*:)[^\d]{0,40}" + AMOUNT)
TTC = tx.led("tTmMnNàÀ", r"(?:total\s+ttc|montant\s+ttc|ttc\s*:?|net\s+à\s+payer|à\s+payer\s*:?|total\s+général)[^\d]{0,40}"
             + AMOUNT)
TVA = tx.led("tTdDmM", r"(?:tva\s+(?:à\s+)?\d[\d,.]?\s*%|dont\s+tva|montant\s+tva)[^\d]{0,40}" + AMOUNT)
RATE = tx.led("tT", r"tva\s*(?:à\s*|au\s*)?(\d{1,2}[,.]?\d?)\s*%")
EMISSION = tx.led("dDéÉfFlL", r"(?:date\s+(?:d['e]?\s*)?(?:émission|facturation|facture|devis|édition|document|établissement)"
                  r"|émis\s+le|fait\s+le|le\s+:)\s*[:\s]?\s*" + DATE)
ECHEANCE = tx.led("dDpPàÀ", r"(?:date\s+(?:d['e]?\s*)?(?:échéance|paiement|règlement|due)|payable\s+(?:le|avant\s+le)"
                  r"|à\s+régler\s+(?:le|avant\s+le))\s*[:\s]?\s*" + DATE)
EXPIRATION = tx.led("vVeEdDjJ", r"(?:valable\s+jusqu['au]*\s+(?:au)?|valide?\s+(?:jusqu['au]*\s+(?:au)?|jusqu'au)"
                    r"|expire\s+le|date\s+(?:de\s+)?(?:fin|expiration|validité)|jusqu'au)\s*[:\s]?\s*" + DATE)
URSSAF_EXPIRATION = tx.led("vV", r"valable?\s+jusqu['au]*\s+(?:au)?\s*(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4})")
# No decimal digit but the ASCII ones lies before U+0660.
_MAYBE_DIGIT = r"^\x00-/:-\x{65F}"
ANY_DATE = [tx.led(_MAYBE_DIGIT, pattern) for pattern in (
    r"\b(\d{1,2})[/\-\.](\d{1,2})[/\-\.](\d{4})\b",
    r"\b(\d{4})[/\-\.](\d{1,2})[/\-\.](\d{1,2})\b",
    r"\b(\d{1,2})\s+(janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)"
    r"\s+(\d{4})\b",
    r"\b(\d{1,2})\s+(jan|fév|mar|avr|mai|jun|jul|aoû|sep|oct|nov|déc)\.?\s+(\d{4})\b",
)]
NUMBER_FACTURE = tx.led("fFnNrR", r"(?:facture\s*n[o°]?\s*:?|n[o°]\s*(?:de\s+)?facture\s*:?|ref[.\s]*facture\s*:?)\s*"
                        r"([A-Z0-9\-_/]{3,25})")
NUMBER_DEVIS = tx.led("dDnNoO", r"(?:devis\s*n[o°]?\s*:?|n[o°]\s*(?:du\s+)?devis\s*:?|offre\s*n[o°]?\s*:?)\s*"
                      r"([A-Z0-9\-_/]{3,25})")
NUMBER_ANY = tx.led("nNrR", r"(?:n[o°]\s*:?|numéro\s*:?|ref[.\s]*:?)\s*([A-Z0-9\-_/]{4,25})")
SIRET_LABELLED = tx.led("sS\u017FnN", r"(?:siret|n[o°]?\s*siret)\s*[:\s]?\s*(\d[\d\s.\-]{12,18}\d)")
SIRET_FREE = r"(?U)\b(\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d{5})\b"
SIRET_WORD = r"(?iU)\bsiret\b"
# Candidates hold no letters, so searching for both at once finds what searching for each finds.
SIRET_OR_WORD = r"(?U)\b(?:\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d{5}|(?i:siret))\b"
SIREN_LABELLED = tx.led("sS\u017FnN", r"(?:siren|n[o°]?\s*siren)\s*[:\s]?\s*(\d[\d\s.\-]{7,11}\d)")
TVA_NUMBER = tx.led("fF", r"\b(FR[\s.\-]?[0-9A-Z]{2}[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3})\b")
# In the text as it was read, these match wherever a pattern matches in the text whose confused letters were corrected: in place of a
# digit, and inside a number, they also take such letters and all that lies beyond Latin-1. A label that the correction itself turns
# into digits is left out (its SI ends a run of eight characters, or its S does).
_READ = "0123456789" + tx.CONFUSED + r"\u0100-\x{10FFFF}"
_BLANK, _GAP = f"[{tx.SPACE}]", f"[{tx.SPACE}.\\-]?"
AS_READ = {
    "siret": (r"(?U)[sS\u017F](?i)iret(?-i)" + f"(?<!{tx.RUN_CLASS}{{6}}SI.{{3}})(?<!{tx.RUN_CLASS}{{7}}S.{{4}})"
              + f"{_BLANK}*[:{tx.SPACE}]?{_BLANK}*([{_READ}][{_READ}{tx.SPACE}.\\-]{{12,18}}[{_READ}])", 1),
    "tva": (r"(?U)[fF](?<=\b[fF])(?i)R" + _GAP + "[0-9A-Z]{2}(?-i)" + _GAP + _GAP.join([f"[{_READ}]{{3}}"] * 3) + r"\b", 0),
}
# Any other character may be a letter to be corrected, or only stand in for a digit. Spelled out: one bit set, not a range at a time.
UNSURE = r"[^0123456789ACDEFGHJKLMNPQRTUVWXYabcdefghijkmnpqrstuvwxyz .\-\t\n]"
IBAN_LABELLED = r"(?iU)(?:iban|i\.b\.a\.n\.?)\s*[:\s]?\s*(FR[\d\s]{20,35})"
IBAN_FREE = tx.led("fF", r"\b(FR\d{2}[\s]{0,2}\d{4}[\s]{0,2}\d{4}[\s]{0,2}\d{4}[\s]{0,2}\d{4}[\s]{0,2}\d{4}[\s]{0,2}\d{2,3})\b")
BIC_LABEL = (r"(?iU)(?:(?:code[\s\-]?)?bic(?:[\s/]?swift)?|swift(?:[\s/]?(?:code|bic))?|identifiant[\s\-](?:bic|swift)"
             r"|code[\s\-]établissement)")
BIC_LABELLED = BIC_LABEL + r"[\s:/]*([A-Za-z]{4}\s?[A-Za-z]{2}\s?[A-Za-z0-9]{2}(?:\s?[A-Za-z0-9]{3})?)"
# Variant that accepts a remark in brackets after the label and never reads past the end of the line.
BIC_LABELLED_LINE = BIC_LABEL + (r"[ \t]*(?:\([^)\n]*\))?[ \t:/]*([A-Za-z]{4}[ \t]?[A-Za-z]{2}[ \t]?[A-Za-z0-9]{2}"
                                 r"(?:[ \t]?[A-Za-z0-9]{3})?)\b")
BIC_FREE = r"(?U)\b([A-Z]{4}\s?[A-Z]{2}\s?[A-Z0-9]{2}(?:\s?[A-Z0-9]{3})?)\b"
BIC_IBAN_MARGIN = 150
BANK = r"(?iUd)(?:domiciliation|banque|établissement)\s*[:\s]\s*([A-Za-zÀ-ÿ\s\-]{3,50}?)(?:\n|$)"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÉÈÊÙÛÇ"
# What ``[A-Za-zÀ-ÿ\s\-&]`` says, spelled out so that a character is looked up in a bit set.
_NAME = ("[ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100))) + r"\-\&" + tx.SPACE + "]")
# The legal form ends at a word boundary, so no two of them end a name at the same place; their order does not matter.
COMPANY = tx.led(_CAPITALS, r"\b(?:[" + _CAPITALS + "]" + _NAME + r"{2,50}(?=[SEG])(?:SAS|SA|SARL|EURL|SNC|SCI|SASU|EI|EIRL|SCP|GIE|GIP|SELARL)"
                 r"|(?=[SE])(?:SAS|SA|SARL|EURL|SNC|SCI|SASU|EI|EIRL)\s+[" + _CAPITALS + "]" + _NAME + r"{2,50})\b", flags="")
STREETS = "rue|avenue|boulevard|allée|impasse|chemin|route|place|résidence|cité|domaine|voie"
ADDRESS = tx.led(_MAYBE_DIGIT, r"\b(\d{1,5}[,\s]+(?:" + STREETS + r")[,\s]+[A-Za-zÀ-ÿ\s\-,]{5,60}[,\s]+\d{5}[,\s]+"
                 r"[A-Za-zÀ-ÿ\s]{2,30})\b")
ADDRESS_LINE = tx.led(_MAYBE_DIGIT, r"\b(\d{1,5}[, \t]+(?:" + STREETS + r")[, \t]+[A-Za-zÀ-ÿ \t\-,]{5,60}[, \t]+\d{5}[, \t]+"
                      r"[A-Za-zÀ-ÿ \t]{2,30})\b")

TYPES_WITH_AMOUNTS = ["FACTURE", "DEVIS"]
TYPES_WITH_TVA_NUMBER = ["FACTURE", "DEVIS", "SIRET", "KBIS"]


def nearest_siret(text: Column) -> Column:
    """The 14-digit candidate nearest to the word SIRET; ties, and texts without the word, take the earliest one.

    One fold over the pieces between candidates and words, linear in their number: it carries the place reached, the last word and
    the last candidate seen, and the best candidate so far. A candidate is as near as the last word before it or the next one
    after it, and of the candidates before a word the last one is the nearest.
    """
    pieces = F.split(text, SIRET_OR_WORD, -1)
    found = F.regexp_extract_all(text, F.lit(SIRET_OR_WORD), F.lit(0))
    steps = F.zip_with(pieces, found, lambda piece, match: F.struct(F.length(piece).alias("gap"), match.alias("match")))
    nothing = F.struct(F.lit(None).cast("int").alias("distance"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("text"))
    begin = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("word"), nothing.alias("last"), nothing.alias("first"), nothing.alias("best"))

    def candidate(distance, start, match):
        return F.struct(distance.alias("distance"), start.alias("start"), match.alias("text"))

    def step(acc, item):
        start, match = acc["at"] + item["gap"], item["match"]
        is_word = match.rlike(r"\p{L}")
        here = candidate(F.lit(0), start, match)
        before = F.when(acc["word"].isNotNull(), candidate(start - acc["word"], start, match))
        after = F.when(acc["last"]["start"].isNotNull(), candidate(start - acc["last"]["start"], acc["last"]["start"], acc["last"]["text"]))
        near = F.when(is_word, after).otherwise(before)
        best = F.when(acc["best"]["start"].isNull(), near).otherwise(F.least(acc["best"], F.coalesce(near, acc["best"])))
        return F.when(match.isNull(), acc).otherwise(F.struct(
            (start + F.length(match)).alias("at"), F.when(is_word, start).otherwise(acc["word"]).alias("word"),
            F.when(is_word, acc["last"]).otherwise(here).alias("last"),
            F.when(is_word | acc["first"]["start"].isNotNull(), acc["first"]).otherwise(here).alias("first"),
            F.coalesce(best, nothing).alias("best")))

    chosen = F.aggregate(steps, begin, step, lambda acc: F.coalesce(acc["best"]["text"], acc["first"]["text"]))
    return identifiers.clean_number(chosen)


def labelled_siret(text: Column) -> Column:
    return identifiers.clean_number(tx.first_match(SIRET_LABELLED, text))


def extract_siret(text: Column, labelled: Column = None) -> Column:
    """Labelled SIRET, otherwise the nearest candidate. A ``labelled`` column holds the label's number already; without it the
    pattern is planned once for the question and once for the answer."""
    labelled = labelled_siret(text) if labelled is None else labelled
    return F.when(F.length(labelled) == 14, labelled).otherwise(nearest_siret(text))


def first_corrected(df: DataFrame, kind: str, pattern: str, text_col: str, output: str) -> DataFrame:
    """Add the first match of a pattern in the corrected text (``fix_numeric_ocr``), correcting only the texts where it matters.

    A match in the corrected text begins where ``AS_READ`` matches in the text as read. So a text without such a place has none;
    if the first such place holds only characters that the correction leaves alone, it is the match; else the text is corrected.
    """
    read = df.withColumn("_read", F.regexp_extract(text_col, *AS_READ[kind]))
    judged = read.withColumn("_unsure", F.col("_read").rlike(UNSURE))
    corrected = F.when(F.col("_unsure"), tx.fix_numeric_ocr(F.col(text_col)))
    found = judged.withColumn("_corrected", tx.first_match(pattern, corrected))
    sure = F.nullif(F.col("_read"), F.lit(""))
    return found.withColumn(output, F.when(F.col("_unsure"), F.col("_corrected")).otherwise(sure)).drop("_read", "_unsure", "_corrected")


def with_siret(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``siret`` and ``body``, the corrected text of those rows only whose label does not give the number."""
    labelled = first_corrected(df, "siret", SIRET_LABELLED, text_col, "_label").withColumn("_label", identifiers.clean_number(F.col("_label")))
    known = F.coalesce(F.length("_label") == 14, F.lit(False))
    rest = labelled.withColumn("body", F.when(~known, tx.fix_numeric_ocr(F.col(text_col))))
    return rest.withColumn("siret", extract_siret(F.col("body"), F.col("_label"))).drop("_label")


def with_tva_number(df: DataFrame, text_col: str) -> DataFrame:
    found = first_corrected(df, "tva", TVA_NUMBER, text_col, "_tva")
    return found.withColumn("tva_number", F.upper(identifiers.clean_number(F.col("_tva")))).drop("_tva")


def extract_siren(text: Column, siret: Column) -> Column:
    labelled = identifiers.clean_number(tx.first_match(SIREN_LABELLED, text))
    return F.when(F.length(siret) == 14, F.substring(siret, 1, 9)).when(F.length(labelled) == 9, labelled)


def extract_tva_number(text: Column) -> Column:
    return F.upper(identifiers.clean_number(tx.first_match(TVA_NUMBER, text)))


def complete_amounts(ht: Column, tva: Column, ttc: Column) -> dict:
    """Deduce the one missing amount; a deduced VAT must imply a plausible rate."""
    tva_deduced = F.round(ttc - ht, 2)
    ht_deduced = F.round(ttc - tva, 2)
    return {
        "montant_ht": F.when(
            ht.isNull() & amounts.rate_plausible(ht_deduced, tva), ht_deduced).otherwise(ht),
        "montant_tva": F.when(
            tva.isNull() & amounts.rate_plausible(ht, tva_deduced), tva_deduced).otherwise(tva),
        "montant_ttc": F.coalesce(ttc, F.round(ht + tva, 2)),
    }


def rate_of(raw: Column, ht: Column, tva: Column) -> Column:
    """The rate captured from the text, otherwise the legal rate nearest to the one the amounts imply."""
    written = F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")
    implied = F.round(F.try_divide(tva, ht) * 100, 1)
    return F.when(
        raw.isNotNull(), amounts.snap_rate(written, amounts.TEXT_RATE_TOLERANCE, keep_unmatched=True)
    ).otherwise(amounts.snap_rate(implied, amounts.COMPUTED_RATE_TOLERANCE, keep_unmatched=False))


def extract_rate(text: Column, ht: Column, tva: Column) -> Column:
    return rate_of(tx.first_match(RATE, text), ht, tva)


def extract_number(text: Column, doc_type: Column) -> Column:
    return F.coalesce(
        tx.first_match(NUMBER_FACTURE, F.when(doc_type == "FACTURE", text)),
        tx.first_match(NUMBER_DEVIS, F.when(doc_type == "DEVIS", text)), tx.first_match(NUMBER_ANY, text))


def _compact(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"(?U)\s", "")


def extract_iban(text: Column) -> Column:
    labelled = _compact(tx.first_match(IBAN_LABELLED, text))
    return F.when(F.length(labelled) == 27, labelled).otherwise(_compact(tx.first_match(IBAN_FREE, text)))


def bic_near_iban(text: Column) -> Column:
    """First valid BIC within the margin around the IBAN."""
    iban = F.nullif(F.regexp_extract(text, IBAN_FREE, 0), F.lit(""))
    start = F.length(F.get(F.split(text, IBAN_FREE, 2), F.lit(0)))
    around = F.upper(tx.vicinity(text, start, F.length(iban), BIC_IBAN_MARGIN))
    nearby = F.filter(
        F.transform(F.regexp_extract_all(around, F.lit(BIC_FREE), F.lit(1)), _compact), identifiers.bic_valid
    )
    return F.when(iban.isNotNull(), F.get(nearby, F.lit(0)))


def extract_bic(text: Column, single_line: bool = False) -> Column:
    """Labelled BIC, otherwise the first valid one around the IBAN."""
    labelled = _compact(tx.first_match(BIC_LABELLED_LINE if single_line else BIC_LABELLED, text))
    return F.when(identifiers.bic_valid(labelled), labelled).otherwise(bic_near_iban(text))


def extract_bank(text: Column) -> Column:
    return tx.title_case(tx.first_match(BANK, text))


def extract_company_name(text: Column, heading_chars: int | None = None) -> Column:
    """Company name by its legal form; either alternative of the pattern is the whole match.

    The whole text is searched; ``heading_chars=2000`` looks at the heading only, as the reference behaviour does.
    """
    return tx.first_match(COMPANY, text if heading_chars is None else tx.slice_head(text, heading_chars), 0)


def extract_address(text: Column, single_line: bool = False) -> Column:
    return tx.strip(F.regexp_replace(
        tx.first_match(ADDRESS_LINE if single_line else ADDRESS, text), r"(?U)\s+", " "
    ))


def extract_fields(df: DataFrame, text_col: str = "ocr_text", type_col: str = "doc_type", output: str = "extracted",
                   strict_reference: bool = True, single_line: bool = False, amount_limit: float | None = None,
                   years: tuple | None = None) -> DataFrame:
    """Add the ``extracted`` struct. Unlisted types follow the invoice rules, blank text gives NULL fields. Amounts and dates of
    any size count; ``amount_limit=amounts.AMOUNT_LIMIT`` and ``years=dates.PLAUSIBLE_YEARS`` drop what the reference drops.

    The steps are separate projections: raw captures, fallback captures for the rows that need them, parsed values, and
    the struct. A capture that is parsed is referred to many times, and generated code evaluates a shared expression once
    only outside conditional branches, so each capture is materialised as a column before it is parsed.
    """
    upper_type = F.upper(F.col(type_col))
    kind, body = F.col("_kind"), F.col("_body")
    with_amounts = kind.isin(TYPES_WITH_AMOUNTS)
    with_expiry = kind.isin("DEVIS", "SIRET", "URSSAF", "KBIS")

    def parsed(name):
        return dates.parse_numeric_date(F.col(name), strict_reference, years)

    def only(condition, pattern, group=1):
        # The input is gated, not the result: inside a branch the pattern would be planned twice.
        return tx.first_match(pattern, F.when(condition, body), group)

    steps = [
        {
            "_kind": F.when(upper_type.isin("DEVIS", "SIRET", "URSSAF", "KBIS", "RIB"), upper_type)
            .otherwise(F.lit("FACTURE")),
            "_body": F.when(~tx.is_blank(F.col(text_col)), tx.fix_numeric_ocr(F.col(text_col))),
        },
        {
            "_siret_label": labelled_siret(body),
            "_ht_raw": only(with_amounts, HT),
            "_tva_raw": only(with_amounts, TVA),
            "_ttc_raw": only(with_amounts, TTC),
            "_rate_raw": only(with_amounts, RATE),
            "_emission_raw": only(kind != "RIB", EMISSION),
            "_echeance_raw": only(with_amounts, ECHEANCE),
            "_expiration_raw": only(with_expiry, EXPIRATION),
            "_number": extract_number(F.when(with_amounts, body), kind),
            "_tva_number": extract_tva_number(F.when(kind.isin(TYPES_WITH_TVA_NUMBER), body)),
            "_iban_label": _compact(only(kind == "RIB", IBAN_LABELLED)),
            "_bic_label": _compact(only(kind == "RIB", BIC_LABELLED_LINE if single_line else BIC_LABELLED)),
            "_bank": extract_bank(F.when(kind == "RIB", body)),
            "_company": extract_company_name(body),
            "_address": extract_address(body, single_line),
        },
        {
            "_siret": F.when(F.length("_siret_label") == 14, F.col("_siret_label")).otherwise(nearest_siret(body)),
            "_ht": amounts.parse_amount(F.col("_ht_raw"), amount_limit),
            "_tva": amounts.parse_amount(F.col("_tva_raw"), amount_limit),
            "_ttc": amounts.parse_amount(F.col("_ttc_raw"), amount_limit),
            "_emission_label": parsed("_emission_raw"),
            "_echeance": parsed("_echeance_raw"),
            "_expiration_label": parsed("_expiration_raw"),
            "_iban": F.when(F.length("_iban_label") == 27, F.col("_iban_label")).when(
                kind == "RIB", _compact(tx.first_match(IBAN_FREE, body))),
            "_bic": F.when(identifiers.bic_valid(F.col("_bic_label")), F.col("_bic_label")).when(
                kind == "RIB", bic_near_iban(body)),
        },
        {
            **{f"_date_{i}": only((kind != "RIB") & F.col("_emission_label").isNull(), pattern, 0)
               for i, pattern in enumerate(ANY_DATE)},
            "_urssaf_raw": only((kind == "URSSAF") & F.col("_expiration_label").isNull(), URSSAF_EXPIRATION),
            **{f"_{name}": c
               for name, c in complete_amounts(F.col("_ht"), F.col("_tva"), F.col("_ttc")).items()},
        },
        {
            "_emission": F.coalesce(F.col("_emission_label"), parsed("_date_0"), parsed("_date_1"), *[
                dates.parse_worded_date(F.col(f"_date_{i}"), strict_reference, years) for i in (2, 3)]),
            "_rate": F.when(with_amounts, rate_of(F.col("_rate_raw"), F.col("_montant_ht"), F.col("_montant_tva"))),
        },
        {
            "_expiration": F.when(kind == "DEVIS", F.coalesce("_expiration_label", "_echeance"))
            .when(kind == "URSSAF", F.coalesce(F.col("_expiration_label"), parsed("_urssaf_raw")))
            .when(kind == "KBIS", F.coalesce(F.col("_expiration_label"), F.date_add(
                dates.parse_iso(F.col("_emission")), dates.KBIS_VALIDITY_DAYS).cast("string")))
            .otherwise(F.col("_expiration_label")),
        },
    ]
    staged = df
    for step in steps:
        staged = staged.withColumns(step)
    siret = F.col("_siret")
    fields = {
        "siret": siret,
        "siren": extract_siren(body, siret),
        "tva_number": F.col("_tva_number"),
        "montant_ht": F.col("_montant_ht"),
        "montant_tva": F.col("_montant_tva"),
        "montant_ttc": F.col("_montant_ttc"),
        "taux_tva": F.col("_rate"),
        "date_emission": F.col("_emission"),
        "date_echeance": F.when(kind == "DEVIS", F.col("_expiration")).otherwise(F.col("_echeance")),
        "date_expiration": F.col("_expiration"),
        "numero_document": F.col("_number"),
        "raison_sociale": F.col("_company"),
        "iban": F.col("_iban"),
        "bic": F.col("_bic"),
        "banque": F.col("_bank"),
        "adresse": F.col("_address"),
    }
    extracted = F.struct(*[fields[name].alias(name) for name in schemas.EXTRACTED_FIELDS])
    return staged.select(*[c for c in df.columns if c != output], extracted.alias(output))


def compact_extracted(extracted: Column) -> Column:
    """Map of the fields that were found, as text."""
    entries = []
    for name in schemas.EXTRACTED_FIELDS:
        value = amounts.plain_number(extracted[name]) if name in schemas.AMOUNT_FIELDS else extracted[name]
        entries += [F.lit(name), value]
    return F.map_filter(F.create_map(*entries), lambda _, value: value.isNotNull())


def fields_found(extracted: Column) -> Column:
    """Number of non-null fields, as plain additions that stay in generated code."""
    return sum((F.when(extracted[name].isNotNull(), 1).otherwise(0) for name in schemas.EXTRACTED_FIELDS), F.lit(0))

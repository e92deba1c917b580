"""Text clean-up, tokens and bounded windows as column expressions.

Patterns carry ``(?U)`` so that word, digit and blank classes are Unicode-aware.
"""

from pyspark.sql import Column, functions as F

# Ordered corrections of common recognition artefacts.
OCR_CORRECTIONS = [
    (r"(?U)\bI€\b", "Le"),
    (r'(?U)\bI"s\b', "Les"),
    (r"0(?=[A-Z])", "O"),
    (r"(?<=[A-Z])0", "O"),
    (r"\|", "I"),
    (r"§IRET", "SIRET"),
    (r"§IREN", "SIREN"),
    (r"(?U)TVl\b", "TVA"),
]
# Matches in a text exactly where one of these patterns does.
OCR_ARTEFACT = r'(?U)(?=[I0|§T])(?:\bI(?:€|"s)\b|0(?=[A-Z])|(?<=[A-Z])0|\||§IRE[TN]|TVl\b)'
# Ordered substitutions that turn text into features.
FEATURE_SUBSTITUTIONS = [
    (r"(?U)\d[\d\s]*[,.]\d{2}\s*(?:€|eur)", " montant_eur "),
    (r"(?U)\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}", " date_doc "),
    (r"(?U)\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}", " date_doc "),
    (r"(?U)\b\d{14}\b", " num_siret "),
    (r"(?U)\b\d{9}\b", " num_siren "),
    (r"(?U)\bfr[\s\d]{11,13}\b", " num_tva "),
    (r"(?U)\bfr\d{2}[\s\d]{23,27}\b", " num_iban "),
    (r"[━─═]{3,}", " separateur "),
    (r"(?U)[^\w\sàâäéèêëïîôùûüç]", " "),
    (r"(?U)\s+", " "),
]
# Letters read in place of digits inside long numeric runs.
DIGIT_CONFUSIONS = [("[Oo]", "0"), ("[lI]", "1"), ("B", "8"), ("S", "5"), ("Z", "2")]
CONFUSED = "OolIBSZ"
RUN_LENGTH = 8
# Characters of ``(?U)\s``, spelled out: the property is looked up per character, these are a bit set and, beyond Latin-1, one range test.
SPACE = r"\t\n\x0B\f\r \x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
RUN_CLASS = r"[0123456789OolIBSZ.\-" + SPACE + "]"
NATIVE_TEXT_MIN_CHARS = 50
USABLE_MIN_CHARS = 20
USABLE_MIN_CONFIDENCE = 0.2


# Characters that count as blank.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def first_match(pattern: str, text: Column, group: int = 1) -> Column:
    """Trimmed capture of the first match, NULL when there is none."""
    return F.nullif(strip(F.regexp_extract(text, pattern, group)), F.lit(""))


def led(first: str, pattern: str, flags: str = "i") -> str:
    """A Unicode-aware pattern that is only tried at the characters of a class. ``first`` has to list every character a match may
    begin with, in both cases (the long s folds to s, the Kelvin sign to k); a look at a bit set is much cheaper than a word
    boundary or the alternatives of a label at every character."""
    return f"(?U)(?=[{first}])(?{flags})" + pattern if flags else f"(?U)(?=[{first}])" + pattern


def all_matches(pattern: str, text: Column, group: int = 1) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.transform(F.filter(found, lambda m: m != ""), strip)


def fix_numeric_ocr(text: Column, digits_only: bool = False) -> Column:
    """Turn confused letters into digits inside runs of at least eight number-like characters.

    A letter belongs to such a run exactly when some window of eight run characters contains it, which look-around can
    test at the letter itself; no tokenising of the text is needed. ``digits_only`` leaves blanks out of the runs, which
    keeps a label that follows a number intact. Most texts have no letter in a run, which one search from letter to letter settles;
    a digit in place of a letter leaves every run as it is, so what holds before the first substitution holds for all of them.
    """
    run = r"[0123456789OolIBSZ.\-]" if digits_only else RUN_CLASS
    windows = "|".join(
        f"(?<={run}{{{before}}})(?={run}{{{RUN_LENGTH - before}}})" for before in range(1, RUN_LENGTH + 1)
    )
    fixed = text
    for letters, digit in DIGIT_CONFUSIONS:
        fixed = F.regexp_replace(fixed, f"{letters}(?:{windows})", digit)
    confused = "".join(letters.strip("[]") for letters, _ in DIGIT_CONFUSIONS)
    # Seven more run characters lie around the letter, so at least four on one side; that is seldom so and settled first.
    half = RUN_LENGTH // 2
    one_side = f"(?:(?={run}{{{half}}})|(?<={run}{{{half + 1}}}))"
    return F.when(text.rlike(f"[{confused}]{one_side}(?:{windows})"), fixed).otherwise(text)


def clean_ocr_text(text: Column) -> Column:
    """Correct artefacts, squeeze blanks and drop every line without a letter, digit or euro sign."""
    read = F.coalesce(text, F.lit(""))
    out = read
    for pattern, replacement in OCR_CORRECTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    # Where no artefact is found at first, no step finds one: most texts take one search for all of them.
    out = F.when(read.rlike(OCR_ARTEFACT), out).otherwise(read)
    # Single blanks stay as they are, so a text with no others is not built anew.
    out = F.regexp_replace(out, r"\t[ \t]*| [ \t]+", " ")
    out = F.regexp_replace(out, r"(?md)^[^a-zA-Z0-9€\n]*(?:\n|\z)", "")
    return strip(out)


def normalize_for_tfidf(text: Column) -> Column:
    out = F.lower(text)
    for pattern, replacement in FEATURE_SUBSTITUTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return strip(out)


def title_case(text: Column) -> Column:
    """Capital after every character that is not a letter."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda piece: F.initcap(piece)), "")


def word_count(text: Column) -> Column:
    """Number of blank-separated tokens."""
    squeezed = strip(F.coalesce(text, F.lit("")))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.size(F.split(squeezed, r"(?U)\s+")))


def page_count(text: Column) -> Column:
    """Pages of native text, which are separated by one empty line."""
    return F.regexp_count(text, F.lit("\n\n")) + F.lit(1)


def is_native_text(text: Column, min_chars: int = NATIVE_TEXT_MIN_CHARS) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")) >= min_chars


def is_usable(text: Column, confidence: Column) -> Column:
    return F.coalesce(
        (F.length(strip(text)) > USABLE_MIN_CHARS) & (confidence > USABLE_MIN_CONFIDENCE), F.lit(False)
    )


def slice_head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def vicinity(text: Column, start: Column, length: Column, margin: int) -> Column:
    """Text from ``margin`` characters before a zero-based match to ``margin`` characters after it."""
    begin = F.greatest(start - margin, F.lit(0))
    return F.substring(text, begin + 1, start + length + margin - begin)


def dedupe_keep_order(items: Column) -> Column:
    return F.array_distinct(items)


def to_record_json(record: Column) -> Column:
    return F.to_json(record)


def from_record_json(text: Column, schema) -> Column:
    return F.from_json(text, schema)

"""Company, tax and bank identifiers as column expressions."""

from functools import reduce

from pyspark.sql import Column, functions as F

from dossierlens.functions.text import SPACE

# Wording of the findings.
SIRET_ABSENT = "SIRET absent"
SIRET_LENGTH = "SIRET longueur incorrecte : %d chiffres (attendu 14)"
SIRET_CHARS = "SIRET contient des caractères non numériques"
SIRET_LUHN = "SIRET invalide (échec contrôle Luhn) : %s"
SIRET_OK = "SIRET valide"
IBAN_ABSENT = "IBAN absent"
IBAN_SHAPE = "Format IBAN français incorrect : %s"
IBAN_MOD97 = "IBAN invalide (échec contrôle MOD-97) : %s"
IBAN_CHARS = "IBAN contient des caractères invalides"
IBAN_OK = "IBAN valide"
TVA_ABSENT = "Numéro TVA absent"
TVA_SHAPE = "Format TVA incorrect : %s"
TVA_KEY = "Clé TVA incohérente avec SIREN (attendu FR%02d, trouvé FR%02d)"
TVA_OK = "Numéro TVA valide"
# Fixed value: structure of a BIC.
BIC_PATTERN = "^([A-Z]{4})([A-Z]{2})([A-Z0-9]{2})([A-Z0-9]{3})?$"


def verdict(ok: Column, message: Column) -> Column:
    return F.struct(ok.alias("ok"), message.alias("message"))


def absent(c: Column) -> Column:
    """NULL or empty: what the data model treats as a missing identifier."""
    return c.isNull() | (c == "")


def siret_luhn(siret: Column) -> Column:
    """Luhn check of a 14-digit SIRET; La Poste numbers (356…) only need a digit sum divisible by five."""
    digit_sum = reduce(
        lambda a, b: a + b, [F.substring(siret, i, 1).try_cast("int") for i in range(1, 15)]
    )
    return (
        F.when(siret.isNull() | ~siret.rlike("^[0-9]{14}$"), F.lit(False))
        .when(siret.startswith("356"), digit_sum % 5 == 0)
        .otherwise(F.call_function("luhn_check", siret))
    )


def siret_format(siret: Column) -> Column:
    problem = (
        F.when(absent(siret), F.lit(SIRET_ABSENT))
        .when(F.length(siret) != 14, F.format_string(SIRET_LENGTH, F.length(siret)))
        .when(~siret.rlike("^[0-9]+$"), F.lit(SIRET_CHARS))
        .when(~siret_luhn(siret), F.format_string(SIRET_LUHN, siret))
    )
    return verdict(problem.isNull(), F.coalesce(problem, F.lit(SIRET_OK)))


def mod97(alphanumeric: Column) -> Column:
    """Remainder by 97 after letters became two-digit numbers (A=10 … Z=35); NULL for any other character.

    A running remainder per character stays within an int, whereas the full number overflows decimal(38) as soon as the
    account part contains letters.
    """
    def step(remainder, ch):
        digit = ch.between("0", "9")
        letter = ch.between("A", "Z")
        return (
            F.when(ch == "", remainder)
            .when(digit, (remainder * 10 + F.ascii(ch) - 48) % 97)
            .when(letter, (remainder * 100 + F.ascii(ch) - 55) % 97)
        )

    return F.aggregate(F.split(alphanumeric, ""), F.lit(0), step)


def compact_upper(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("")))


def iban_format(iban: Column) -> Column:
    compact = compact_upper(iban)
    remainder = mod97(F.concat(F.substring(compact, 5, 1000), F.substring(compact, 1, 4)))
    problem = (
        F.when(absent(iban), F.lit(IBAN_ABSENT))
        .when(~compact.startswith("FR") | (F.length(compact) != 27), F.format_string(IBAN_SHAPE, compact))
        .when(~compact.rlike("^[0-9A-Z]+$"), F.lit(IBAN_CHARS))
        .when(remainder != 1, F.format_string(IBAN_MOD97, compact))
    )
    return verdict(problem.isNull(), F.coalesce(problem, F.lit(IBAN_OK)))


def iban_check_digits(bban: Column) -> Column:
    return F.lit(98) - mod97(F.concat(bban, F.lit("FR00")))


def tva_key(siren: Column) -> Column:
    return (F.lit(12) + F.lit(3) * (siren.try_cast("bigint") % 97)) % 97


def siren_to_tva(siren: Column) -> Column:
    return F.concat(F.lit("FR"), F.lpad(tva_key(siren).cast("string"), 2, "0"), siren)


def tva_number(tva: Column, siren: Column = None) -> Column:
    """Shape of a French VAT number and, for a numeric key, its agreement with the SIREN."""
    siren = F.lit(None).cast("string") if siren is None else siren
    compact = compact_upper(tva)
    found = F.substring(compact, 3, 2).try_cast("int")
    problem = (
        F.when(absent(tva), F.lit(TVA_ABSENT))
        .when(~compact.startswith("FR") | (F.length(compact) != 13), F.format_string(TVA_SHAPE, compact))
        .when(siren.rlike("^[0-9]{9}$") & (found != tva_key(siren)),
              F.format_string(TVA_KEY, tva_key(siren), found))
    )
    return verdict(problem.isNull(), F.coalesce(problem, F.lit(TVA_OK)))


def bic_valid(bic: Column) -> Column:
    return F.coalesce(compact_upper(bic).rlike(BIC_PATTERN), F.lit(False))


def clean_number(raw: Column) -> Column:
    """Drop blanks, dots and dashes from an identifier; nothing left means NULL."""
    return F.nullif(F.regexp_replace(raw, f"[{SPACE}.\\-]", ""), F.lit(""))

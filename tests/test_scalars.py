"""Literal inputs and outputs of the scalar functions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dossierlens.functions import amounts, dates, identifiers, text as tx

AS_OF = datetime(2026, 1, 1, 9, 0)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("siret,ok", [
    ("73282932000074", True), ("41816609600069", True), ("12345678901234", False), ("1234567890", False),
    ("ABCDEFGHIJKLMN", False), (None, False), ("35600000000007", False), ("35600000000001", True)])
def test_siret(spark, siret, ok):
    assert one(spark, identifiers.siret_luhn(text(siret))) is ok
    assert one(spark, identifiers.siret_format(text(siret))).ok is ok


@pytest.mark.parametrize("iban,ok", [
    ("FR7630006000011234567890189", True), ("fr76 3000 6000 0112 3456 7890 189", True), ("FR" + "0" * 25, False),
    ("DE89370400440532013000", False), (None, False), ("FR76300060000112345678901é9", False)])
def test_iban(spark, iban, ok):
    assert one(spark, identifiers.iban_format(text(iban))).ok is ok


@pytest.mark.parametrize("ht,tva,ttc,rate,ok", [
    (1000.0, 200.0, 1200.0, 20.0, True), (1000.0, 200.0, 1200.5, 20.0, True), (None, 200.0, 1200.0, 20.0, True),
    (1000.0, 200.0, 1205.0, 20.0, True), (1000.0, 200.0, 1250.0, 20.0, False), (1000.0, 100.0, 1100.0, 20.0, False)])
def test_tva_coherence(spark, ht, tva, ttc, rate, ok):
    got = one(spark, amounts.tva_coherence(*[F.lit(v).cast("double") for v in (ht, tva, ttc, rate)]))
    assert got.ok is ok


def test_tva_message(spark):
    got = one(spark, amounts.tva_coherence(*[F.lit(v) for v in (1000.0, 200.0, 1250.0, 20.0)]))
    assert got.message == "Incohérence HT+TVA≠TTC : 1000.0 + 200.0 = 1200.0 ≠ 1250.0 (écart 50.00€)"
    assert got.details["ecart"] == "50.0"


@pytest.mark.parametrize("day,doc_type,status,kind", [
    ("2030-01-01", "URSSAF", "ok", ""), ("2020-01-01", "URSSAF", "error", "URSSAF_EXPIRED"),
    ("2020-01-01", "KBIS", "error", "KBIS_EXPIRED"), (None, "URSSAF", "warning", "MISSING_FIELD"),
    (None, "DEVIS", "ok", ""), ("2026-01-01", "DEVIS", "error", "DATE_EXPIRED"),
    ("2026-02-01", "DEVIS", "warning", "DATE_EXPIRED"), ("2026-02-02", "DEVIS", "ok", "")])
def test_expiration(spark, day, doc_type, status, kind):
    got = one(spark, dates.expiration_status(text(day), F.lit(doc_type), AS_OF))
    assert (got.status, got.anomaly_type) == (status, kind)


@pytest.mark.parametrize("age,status", [(30, "ok"), (100, "error"), (80, "warning"), (75, "ok"), (90, "warning")])
def test_kbis_age(spark, age, status):
    day = (AS_OF - timedelta(days=age)).date().isoformat()
    assert one(spark, dates.kbis_age_status(text(day), AS_OF)).status == status


def test_tva_number(spark):
    assert not one(spark, identifiers.tva_number(text("FR73732829320"), F.lit("732829320"))).ok
    assert one(spark, identifiers.tva_number(text("FR44732829320"), F.lit("732829320"))).ok
    assert one(spark, identifiers.siren_to_tva(F.lit("732829320"))) == "FR44732829320"
    assert not one(spark, identifiers.tva_number(text(None))).ok
    assert not one(spark, identifiers.tva_number(text("DE123456789"))).ok


@pytest.mark.parametrize("raw,strict,free", [
    ("05/03/2024", "2024-03-05", "2024-03-05"), ("03/25/2024", "2024-03-25", "2024-03-25"),
    ("2024-03-05", "2024-05-03", "2024-03-05"), ("2024-03-25", "2024-03-25", "2024-03-25"),
    ("31/02/2024", None, None), ("13/25/2024", None, None), ("12 jan. 2024", "2024-01-12", "2024-01-12"),
    ("12 février 2024", None, "2024-02-12"), ("1/1/1980", "1980-01-01", "1980-01-01"), (None, None, None)])
def test_parse_date(spark, raw, strict, free):
    assert one(spark, dates.parse_date(text(raw))) == strict
    assert one(spark, dates.parse_date(text(raw), strict_reference=False)) == free


@pytest.mark.parametrize("raw,value", [
    ("1 234,56", 1234.56), ("1.234,56", 1234.56), ("1234.56", 1234.56), ("1 234,5", 1234.5), ("0", None),
    ("12 000 000,5", 12000000.5), ("abc", None), ("", None)])
def test_parse_amount(spark, raw, value):
    assert one(spark, amounts.parse_amount(text(raw))) == value
    limited = None if value and value >= amounts.AMOUNT_LIMIT else value
    assert one(spark, amounts.parse_amount(text(raw), amounts.AMOUNT_LIMIT)) == limited


@pytest.mark.parametrize("raw", ["13/02/1985", "13 mar 2051"])
def test_years_of_dates(spark, raw):
    assert one(spark, dates.parse_date(text(raw))) is not None
    assert one(spark, dates.parse_date(text(raw), years=dates.PLAUSIBLE_YEARS)) is None


def test_text_functions(spark):
    assert one(spark, tx.fix_numeric_ocr(F.lit("no 1O3 4567 l8B. Olivier"))) == "n0 103 4567 188. 01ivier"
    assert one(spark, tx.fix_numeric_ocr(F.lit("73282932000074 SIRET"))) == "73282932000074 51RET"
    assert one(spark, tx.fix_numeric_ocr(F.lit("73282932000074 SIRET"), digits_only=True)) == "73282932000074 SIRET"
    assert one(spark, tx.clean_ocr_text(F.lit("0RACLE  A0\n\n\n--\n|  §IRET\n"))) == "ORACLE AO\nI SIRET"
    assert one(spark, tx.title_case(F.lit("caisse d'épargne"))) == "Caisse D'Épargne"
    assert one(spark, tx.word_count(F.lit("  a  b c "))) == 3
    assert one(spark, tx.normalize_for_tfidf(F.lit("Total 1 234,56 € le 01/02/2024"))) == "total montant_eur le date_doc"

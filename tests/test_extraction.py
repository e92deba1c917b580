"""Extraction on hand-written texts, including the documented oddities."""

import random
import re
import time

from pyspark.sql import functions as F

from dossierlens.operators import extraction as ex


def one(spark, build, value, *args):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t"), *args).alias("v")).first().v


def test_siret_nearest_to_word(spark):
    far = "12345678901234 client\n" + "x" * 80 + " 732 829 320 00074 est le numero du siret fournisseur"
    assert one(spark, ex.extract_siret, far) == "73282932000074"
    assert one(spark, ex.extract_siret, "a 12345678901234 b 73282932000074") == "12345678901234"
    assert one(spark, ex.extract_siret, "rien") is None


def nearest(text):
    words = [m.start() for m in re.finditer(r"\bsiret\b", text, re.I)]
    found = [(m.start(), m[0]) for m in re.finditer(r"\b\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d{5}\b", text)]
    best = min(found, key=lambda c: (min([abs(c[0] - w) for w in words], default=0), c[0]), default=(0, None))[1]
    return best and re.sub(r"[\s.\-]", "", best)


def test_nearest_siret_is_that_of_all_pairs(spark):
    random.seed(5)
    pieces = ["12345678901234", "111 222 333 44444", "SIRET", "siret", "mot", "xx", "99999999999999", "1234", "SIRETS", "\n"]
    texts = [" ".join(random.choices(pieces, k=random.randrange(12))) for _ in range(300)] + [""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ex.nearest_siret(F.col("t")).alias("v")).collect()
    assert [(r.t, r.v) for r in rows] == [(t, nearest(t)) for t in texts]


def test_nearest_siret_is_linear(spark):
    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"{10**13 + i}" for i in range(n)) + " siret 99999999999999",)], "t string").select(ex.nearest_siret(F.col("t")).alias("v"))
        started = time.perf_counter()
        assert df.first().v == "99999999999999"
        return time.perf_counter() - started
    seconds(100)
    small, large = min(seconds(10_000) for _ in range(2)), min(seconds(40_000) for _ in range(2))
    assert large < 10 * small + 1 and large < 20


def test_bic(spark):
    assert one(spark, ex.extract_bic, "Code BIC : BNPA FRPP XXX.") == "BNPAFRPPXXX"
    near = "Compte FR76 3000 6000 0112 3456 7890 189 - AGRIFRPP - agence"
    assert one(spark, ex.extract_bic, near) == "AGRIFRPP"
    # The word IBAN and the country code together have the shape of a BIC.
    assert one(spark, ex.extract_bic, near.replace("Compte", "IBAN")) == "IBANFR76"
    crossing = "BIC : BNPAFRPP\nDomiciliation"
    assert one(spark, ex.extract_bic, crossing) == "BNPAFRPPDOM"
    assert one(spark, ex.extract_bic, crossing, True) == "BNPAFRPP"
    assert one(spark, ex.extract_bic, "BIC (SWIFT) : AGRIFRPP", True) == "AGRIFRPP"


def test_address_and_company(spark):
    value = "12 rue de la Paix, 75002 PARIS\nSIRET"
    assert one(spark, ex.extract_address, value) == "12 rue de la Paix, 75002 PARIS SIRET"
    assert one(spark, ex.extract_address, value, True) == "12 rue de la Paix, 75002 PARIS"
    assert one(spark, ex.extract_company_name, "Entre : Dupont et Fils SARL\n12 rue") == "Dupont et Fils SARL"


def test_deductions(spark):
    rows = [("FACTURE", "Total HT : 1000,00 €\nTotal TTC : 1200,00 €"), ("FACTURE", "Total HT : 1000,00\nTTC : 9000"),
            ("AUTRE", "Montant TVA : 200,00\nTotal TTC : 1200,00"), ("KBIS", "Fait le 15/01/2024"), ("RIB", "  ")]
    df = spark.createDataFrame(rows, "doc_type string, ocr_text string")
    got = [r.extracted for r in ex.extract_fields(df).collect()]
    assert (got[0].montant_tva, got[0].taux_tva) == (200.0, 20.0)
    assert got[1].montant_tva is None
    assert got[2].montant_ht == 1000.0
    assert got[3].date_expiration == "2024-04-14"
    assert all(v is None for v in got[4])

"""Inputs on which a registered query once differed from its check, and plans that once did not grow with their input."""

import random
import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

import compare
from dossierlens import session
from dossierlens.catalog import CHECKS, QUERIES, bindings, recognition, streams, tables, understanding
from dossierlens.functions import identifiers, text
from dossierlens.operators import classify, extraction, rules, training, validation

SF_DIR = "/root/testdata/sf0.001"


def _differs(spark, folder, name):
    return compare.differences(spark, compare.connection(folder), str(folder), QUERIES[name], CHECKS[name])


def test_merged_pages_count_the_words_as_read(spark, tmp_path):
    """A line of accented letters alone is dropped from the text, but was read."""
    rows = [(1, 0, "user", "Que doción\nÑóó."), (1, 1, "assistant", "un mot"), (2, 0, "user", "Ñó ñé"), (3, 0, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    assert _differs(spark, tmp_path, "g11_merge_pages") == ""


def test_cleaned_texts_without_any_usable_line(spark, tmp_path):
    rows = [(1, "Ñóó."), (2, "a\nÑ\n b "), (3, ""), (4, None), (5, "\n\n"), (6, "A0 |"), (7, "é | é"), (8, "|"), (9, "ñ €")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert _differs(spark, tmp_path, "n19_clean_ocr_text") == ""


def test_forest_is_fitted_in_a_fixed_number_of_tasks(spark, monkeypatch):
    """The staged rows lie in a few files, which used to decide the number of tasks."""
    seen, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    rows = spark.createDataFrame([(f"facture {('alpha', 'beta', 'gamma')[i % 3]} total", str(i % 2)) for i in range(40)], "text string, label string")
    training.train_forest(rows, trees=2, max_depth=2, vocabulary=10)
    assert seen == [training.FIT_PARTITIONS]


def test_raw_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recognition, "scratch_path", lambda spark, name: str(tmp_path / name))
    files = recognition.text_files(spark, SF_DIR)
    assert files.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert len({path.name[:10] for path in tmp_path.glob("raw/doc_id=*/part-*")}) > 1


def test_queries_limit_generated_methods(spark):
    """A method beyond the limit is never compiled by the JVM; sessions that others build come without the limit."""
    kept = spark.conf.get(session.HUGE_METHOD_LIMIT)
    spark.conf.set(session.HUGE_METHOD_LIMIT, session.SPARK_HUGE_METHOD_LIMIT)
    try:
        QUERIES["e01_extract_siret"](spark, SF_DIR)
        assert spark.conf.get(session.HUGE_METHOD_LIMIT) == session.SETTINGS[session.HUGE_METHOD_LIMIT]
    finally:
        spark.conf.set(session.HUGE_METHOD_LIMIT, kept)


def test_siret_label_is_read_once(spark):
    plan = QUERIES["e01_extract_siret"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:siret|n[o°]?\\s*siret)") == 1


def test_confused_letters_by_brute_force(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("0123 .-\nOoIlBSZxF/") for _ in range(draw.randrange(60))) for _ in range(3000)]
    digits, member = dict(zip("OolIBSZ", "0011852")), re.compile(r"[0-9OolIBSZ\s.\-]{8,}")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fix_numeric_ocr(F.col("t")).alias("fixed"))
    for row in df.collect():
        assert row.fixed == member.sub(lambda m: "".join(digits.get(c, c) for c in m.group()), row.t)


def test_a_long_backlog_takes_no_more_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(streams, "FILE_ROWS", 5)
    assert _differs(spark, SF_DIR, "t02_stream_compliance") == ""
    assert 2 <= len(list(tmp_path.glob("compliance/batch=*"))) <= streams.BATCHES


def test_curated_records_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "scratch_path", lambda spark, name: str(tmp_path / name))
    assert _differs(spark, SF_DIR, "s06_write_curated") == ""
    files = list(tmp_path.glob("curated/doc_type=*/part-*"))
    assert files and all(path.suffix == ".gz" for path in files)


# Characters that labels, numbers and names begin with or end before, among them those that fold to ASCII letters.
PIECES = ["FR", "fr", "Fr", "12", "123", "4567", "12345", "٣", "𝟏", " ", "  ", "\n", " ", " ", ".", "-", ":", ",", "/", "%", "SIRET", "ſiret", "siren",
          "n°", "N", "no ", "SA", "SAS", "SARL", "SASU", "EI", "EIRL", "GIE", "Étude", "Ab", "ÇA", "& Cie", "é", "×", "rue", "PLACE", "total", "HT", " ht :",
          "TTC", "Net à payer", "À PAYER", "tva", "TVA 20%", "dont TVA", "ſous total ht", "montant", "date d'", "émission", "Émis le ", "échéance", "payable le",
          "valable jusqu'au", "expire le", "jusqu'au", "facture", "devis", "offre n°", "ref. ", "mars", "déc", "2024", "01", "_", "x", "DE12", "AB-1/2_3", "€", "01/02/2024",
          "2024-01-02", "1 234,50 €", "12345678900012", "123 456 789", "FR12123456789", "FR7630006000011234567890189", "3, rue des Lilas, 75001 PARIS",
          "valable jusqu'au 01/02/2024", "payable le 01.02.2024", "1 mars 2024", "3 déc. 2024"]


def test_patterns_that_look_at_the_first_character_find_what_they_found(spark):
    """The same places as without the look, whatever the case, width or script of the first character."""
    draw = random.Random(5)
    texts = [("".join(draw.choice(PIECES) for _ in range(draw.randrange(1, 25))),) for _ in range(6000)]
    names = (r"(?U)\b([A-ZÀÂÉÈÊÙÛÇ][A-Za-zÀ-ÿ\s\-&]{2,50}(?:SAS|SA|SARL|EURL|SNC|SCI|SASU|EI|EIRL|SCP|GIE|GIP|SELARL))\b"
             r"|\b((?:SAS|SA|SARL|EURL|SNC|SCI|SASU|EI|EIRL)\s+[A-ZÀÂÉÈÊÙÛÇ][A-Za-zÀ-ÿ\s\-&]{2,50})\b")
    led = [p for p in [*vars(extraction).values(), *extraction.ANY_DATE] if isinstance(p, str) and p.startswith("(?U)(?=[")]
    plain = {p: names if p == extraction.COMPANY else re.sub(r"^\(\?U\)\(\?=\[.*?\]\)\(\?i\)", "(?iU)", p) for p in led}
    assert len(plain) == 22 and all(p not in led for p in plain.values())
    df = spark.createDataFrame(texts, "t string").select("t", *[
        F.struct(F.regexp_extract_all("t", F.lit(new), F.lit(0)).alias("new"), F.regexp_extract_all("t", F.lit(old), F.lit(0)).alias("old")).alias(f"p{i}")
        for i, (new, old) in enumerate(plain.items())])
    rows = df.collect()
    for i, new in enumerate(plain):
        assert not [(r.t, r[f"p{i}"]) for r in rows if r[f"p{i}"].new != r[f"p{i}"].old][:1], new
        assert any(r[f"p{i}"].new for r in rows), new


def test_spelled_out_blanks_are_the_blanks(spark):
    chars = spark.range(0x110000).where("id not between 55296 and 57343").select(F.expr("char(0)").alias("z"), F.col("id")).select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert chars.where(F.col("c").rlike("^[" + text.SPACE + "]$") != F.col("c").rlike(r"(?U)^\s$")).count() == 0
    assert chars.where(F.col("c").rlike("^[" + text.SPACE + "]$")).count() > 20


def test_keywords_are_counted_as_substrings(spark):
    draw, keywords = random.Random(7), [k for words in classify.LEXICON.values() for k in words]
    parts = keywords + [k[i:] for k in keywords for i in (1, 3)] + ["e", "é", " ", "fact"]
    texts = [("".join(draw.choice(parts) for _ in range(draw.randrange(12))),) for _ in range(1500)] + [("",), ("escomptescompte",), ("fact-fact-",)]
    rows = spark.createDataFrame(texts, "t string").select("t", F.array(*[classify.occurrences(F.col("t"), k) for k in keywords]).alias("n")).collect()
    for row in rows:
        assert row.n == [row.t.count(k) for k in keywords], row.t


def test_brief_results_are_the_worded_ones_without_their_wording(spark):
    docs = bindings.documents(spark, SF_DIR)
    worded, brief = (validation.validate_documents(rules.apply_local_rules(docs, bindings.AS_OF, brief=b), bindings.AS_OF) for b in (False, True))
    for part, columns in (("checks", ["document_id", "rule", "status"]), ("anomalies", ["document_id", "supplier_id", "type", "severity", "resolved"])):
        rows = [getattr(v, part).select(*columns) for v in (worded, brief)]
        assert rows[0].count() > 0 and rows[0].exceptAll(rows[1]).count() == rows[1].exceptAll(rows[0]).count() == 0
    plan = rules.apply_local_rules(docs, bindings.AS_OF, brief=True)._jdf.queryExecution().optimizedPlan().toString()
    assert identifiers.SIRET_OK not in plan and rules.MSG_TVA_OK not in plan


def test_only_what_is_read_again_is_staged(spark):
    staged = understanding.judged(spark, SF_DIR)
    assert {f.name for f in staged.schema["extracted"].dataType} == {"siret"} and "ocr_text" not in staged.columns
    assert staged.schema["checks"].dataType.elementType.names == ["rule", "status"]


def test_few_rows_are_fitted_in_few_tasks():
    assert [training.fit_partitions(n) for n in (0, 3184, 25_000, 10 ** 7)] == [4, 4, 10, 16]


def test_term_statistics_read_the_texts_once(spark):
    rows = spark.createDataFrame([("un deux deux trois",), ("deux trois",), (None,), ("un",), ("",)], "text string")
    found = training.term_statistics(rows)
    assert [(r.term, r.tf, r.df) for r in found.collect()] == [("deux", 3, 2), ("deux trois", 2, 2), ("trois", 2, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 0 and "Join" not in plan and plan.count("Generate ") == 1


def test_matches_in_corrected_texts_without_correcting_every_text(spark):
    """What is read equals what the pattern finds in the corrected text, with labels and numbers that the correction changes."""
    draw = random.Random(11)
    parts = PIECES + ["O", "o", "l", "I", "S", "B", "Z", "İ", "ı", "sİRET", "SıRET", "Siret", "sIRET", "SIRET : ", "\nSIRET: ", "SIREN : ", "n° siret ", "      ", " " * 7,
                      "12345", "1234567", "1234567890001", "123456789OOO12", "l2345678900O1Z", "123 456 789 00012", "1234S678900012", "FR", "FR I2", "FROl", "FR12 123 456 78S",
                      "FRSB123456789", "FR12O23456789", "FR12αβγ123456", "²", "½", "١٢٣", "𝟏𝟏𝟏"]
    parts += ["SIRET : ", "12345678900012", "123456789OOO12", "FR12123456789"] * 8
    texts = [("".join(draw.choice(parts) for _ in range(draw.randrange(1, 12))),) for _ in range(25000)] + [("",), (None,)]
    df = spark.createDataFrame(texts, "t string").repartition(8)
    for kind, pattern in (("siret", extraction.SIRET_LABELLED), ("tva", extraction.TVA_NUMBER)):
        found = extraction.first_corrected(df, kind, pattern, "t", "new").withColumn("old", text.first_match(pattern, text.fix_numeric_ocr(F.col("t"))))
        rows = found.withColumn("read", F.regexp_extract("t", *extraction.AS_READ[kind])).collect()
        assert not [r for r in rows if r.new != r.old][:1], kind
        assert sum(r.new is not None and r.new == r.read for r in rows) > 300 and sum(r.new is not None and r.new != r.read for r in rows) > 30, kind
        assert sum(r.new is None and bool(r.read) for r in rows) > 0, kind
    body = F.col("body")
    old = df.withColumn("body", text.fix_numeric_ocr(F.col("t"))).withColumn("siret", extraction.extract_siret(body))
    old = old.select("t", "siret", extraction.extract_siren(body, F.col("siret")).alias("siren"))
    new = extraction.with_siret(df, "t").select("t", "siret", extraction.extract_siren(body, F.col("siret")).alias("siren"))
    assert old.exceptAll(new).count() == new.exceptAll(old).count() == 0 and old.where("siren is not null").count() > 300
    numbers = extraction.with_tva_number(df, "t").select("t", "tva_number")
    assert numbers.exceptAll(df.select("t", extraction.extract_tva_number(text.fix_numeric_ocr(F.col("t"))))).count() == 0


def test_texts_whose_label_gives_the_number_are_not_corrected(spark):
    df = spark.createDataFrame([("SIRET : 12345678900012 (siège)\nTVA : FR12123456789\nImmatriculation",), ("SIRET : 1234567890OO12",), ("12345678900012",)], "t string")
    rows = extraction.with_siret(df, "t").collect()
    assert [(r.siret, r.body) for r in rows] == [("12345678900012", None), ("12345678900012", None), ("12345678900012", "12345678900012")]
    for name in ("e01_extract_siret", "e02_extract_siren", "e03_extract_tva_number"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("CASE WHEN RLIKE(ocr_text") == plan.count("THEN CASE WHEN RLIKE(ocr_text") > 0, name

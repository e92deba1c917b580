"""Suppliers, documents, anomalies and recognition results derived from the test tables.

Amounts are computed in whole cents, so that both engines of a check start from the same doubles.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlens import schemas

AS_OF = datetime(2000, 6, 1, 9, 0)
# Moduli of the part key at which a fault is injected.
FAULTS = {"gross": 17, "luhn": 997, "mismatch": 211, "amounts": 31, "dates": 37, "iban": 41, "bic": 43, "blank": 53}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _check_digit(siren: str) -> str:
    """Luhn digit that completes ``<siren>0001``: from the right every second digit, starting with the 13th, doubles."""
    terms = ["2"]  # the doubled 1 of the suffix; its zeros add nothing
    for i in range(9):
        digit = f"cast({siren} div {10 ** i} % 10 as int)"
        terms.append(f"element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), {digit} + 1)" if i % 2 == 0 else digit)
    return f"(10 - ({' + '.join(terms)}) % 10) % 10"


def _siren(key: str) -> str:
    return f"(100000000 + 7 * ({key}))"


def _siret(key: str, shift: str = "0") -> str:
    """SIRET of the company numbered ``key``; a shift of its check digit breaks it."""
    return f"concat({_siren(key)}, '0001', ({_check_digit(_siren(key))} + {shift}) % 10)"


def _tva_number(key: str) -> str:
    return f"concat('FR', lpad((12 + 3 * ({_siren(key)} % 97)) % 97, 2, '0'), {_siren(key)})"


_NAME = "concat('SOCIETE ', translate(lpad(cast({k} as string), 5, '0'), '0123456789', 'ACDEFGHJKM'), ' SARL')"
_ADDRESS = "concat(cast(1 + {k} % 99 as string), ' RUE DES LILAS, ', cast(75001 + {k} % 20 as string), ' PARIS')"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread compact rows over the cores before they grow into documents.

    A test table is one small file, which Spark reads in one or two tasks, although every row stands for a whole document.
    Only these narrow rows are moved; tables of real documents have enough files and are never reshuffled for this.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    joined = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    return joined.selectExpr(
        "concat('sup-', s_suppkey) as supplier_id", "s_name as name", _siret("s_suppkey") + " as siret",
        f"cast({_siren('s_suppkey')} as string) as siren", _tva_number("s_suppkey") + " as tva_number",
        "n_name as address",
        "case when s_suppkey % 7 = 0 then null when s_suppkey % 11 = 0 then 'no mail' "
        "else concat('contact', s_suppkey, '@example.fr') end as email",
        "cast(null as string) as phone", "cast(null as string) as notes",
        "timestamp '2000-01-01 00:00:00' as created_at", "timestamp '2000-01-01 00:00:00' as updated_at",
        "element_at(array('compliant', 'warning', 'non_compliant', 'pending'), cast(s_suppkey % 4 as int) + 1) "
        "as compliance_status")


def documents_flat(spark: SparkSession, sf_dir: str, spread_rows: bool = False) -> DataFrame:
    """One document per line item, with the fields its type carries and the injected faults."""
    f = FAULTS
    items = table(spark, sf_dir, "lineitem")
    if spread_rows:
        items = spread(items, "l_orderkey")
    d = items.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) as document_id",
        "concat('sup-', l_suppkey) as supplier_id", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "cast(l_quantity as int) as qty", "l_shipdate as upload_timestamp", "cast(l_shipdate as date) as shipped",
        "element_at(array('FACTURE', 'DEVIS', 'SIRET', 'URSSAF', 'KBIS', 'RIB'), cast(l_partkey % 6 as int) + 1) "
        "as doc_type",
        "element_at(array('pending', 'preprocessing', 'ocr_done', 'classified', 'extracted', 'validated', 'processed',"
        " 'error', 'processed', 'processed'), cast(l_partkey % 10 as int) + 1) as status",
        "element_at(array(200, 100, 55, 21), l_linenumber % 4 + 1) as rate10",
        "(cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as int)) + 50) div 100 "
        "as ht_c",
        f"l_suppkey + case when l_partkey % {f['mismatch']} = 0 then 1 else 0 end as siret_key",
        f"doc_type in ('FACTURE', 'DEVIS') and l_partkey % {f['amounts']} <> 0 as has_amounts",
        f"l_partkey % {f['dates']} <> 0 as has_dates",
    ).withColumn("tva_c", F.expr("(ht_c * rate10 + 500) div 1000")).withColumn(
        "ttc_c", F.expr(
            f"ht_c + tva_c + case when l_partkey % {f['gross']} = 0 then 5000 + ht_c div 50 else 0 end"))
    bban = ("concat('30006', lpad(cast(l_suppkey as string), 5, '0'), lpad(cast(l_partkey as string), 11, '0'), "
            "lpad(cast(l_orderkey % 97 as string), 2, '0'))")
    key = "lpad(cast(98 - cast(cast(concat(bban, '152700') as decimal(38,0)) % 97 as int) as string), 2, '0')"
    return d.selectExpr(
        "*",
        _siret("siret_key", f"case when l_partkey % {f['luhn']} = 0 then 1 else 0 end") + " as siret",
        f"{bban} as bban",
    ).selectExpr(
        "document_id", "supplier_id", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "upload_timestamp", "status", "doc_type",
        "concat(element_at(array('facture', 'devis', 'siret', 'urssaf', 'kbis', 'rib'), cast(l_partkey % 6 as int) + 1), "
        "'-', document_id, '.pdf') as original_filename",
        "siret", f"cast({_siren('siret_key')} as string) as siren",
        f"case when doc_type in ('FACTURE', 'DEVIS', 'KBIS') then {_tva_number('l_suppkey')} end as tva_number",
        "case when has_amounts then ht_c / 100.0D end as montant_ht",
        "case when has_amounts then tva_c / 100.0D end as montant_tva",
        "case when has_amounts then ttc_c / 100.0D end as montant_ttc",
        "case when has_amounts then rate10 / 10.0D end as taux_tva",
        "case when has_dates and doc_type <> 'RIB' then cast(shipped as string) end as date_emission",
        "case when has_dates then cast(case when doc_type = 'FACTURE' then date_add(shipped, 30) "
        "when doc_type = 'DEVIS' then date_add(shipped, 4 * qty) end as string) end as date_echeance",
        "case when has_dates then cast(case when doc_type in ('DEVIS', 'URSSAF') then date_add(shipped, 4 * qty) "
        "when doc_type = 'KBIS' then date_add(shipped, 90) end as string) end as date_expiration",
        "case when doc_type = 'FACTURE' then concat('FACT-', l_orderkey, '-', l_linenumber) "
        "when doc_type = 'DEVIS' then concat('DEV-', l_orderkey, '-', l_linenumber) end as numero_document",
        _NAME.format(k="l_suppkey") + " as raison_sociale",
        f"case when doc_type = 'RIB' then concat('FR', case when l_partkey % {f['iban']} = 0 then '00' else {key} end,"
        " bban) end as iban",
        f"case when doc_type = 'RIB' and l_partkey % {f['bic']} <> 0 then "
        "element_at(array('BNPAFRPP', 'SOGEFRPP', 'AGRIFRPP', 'CEPAFRPP751'), cast(l_suppkey % 4 as int) + 1) end "
        "as bic",
        "case when doc_type = 'RIB' then element_at(array('Bnp Paribas', 'Société Générale', 'Crédit Agricole', "
        "'Banque Populaire'), cast(l_suppkey % 4 as int) + 1) end as banque",
        _ADDRESS.format(k="l_suppkey") + " as adresse",
        f"case when l_partkey % {f['blank']} = 0 then '   ' else 'texte lu' end as ocr_text",
        "(l_orderkey % 100) / 100.0D as ocr_quality_score",
        "'application/pdf' as mime_type", "cast(1000 + l_orderkey as bigint) as file_size_bytes",
    )


def nest(flat: DataFrame) -> DataFrame:
    """Pack the flat fields into the ``extracted`` struct."""
    extracted = F.struct(*[F.col(c).alias(c) for c in schemas.EXTRACTED_FIELDS])
    return flat.withColumn("extracted", extracted).drop(*schemas.EXTRACTED_FIELDS)


def documents(spark: SparkSession, sf_dir: str, spread_rows: bool = False) -> DataFrame:
    return nest(documents_flat(spark, sf_dir, spread_rows))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings derived from the event log."""
    return anomalies_of(table(spark, sf_dir, "events"))


def anomalies_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "concat('an-', event_id) as anomaly_id", "concat('sup-', user_id) as supplier_id",
        "concat('doc-', user_id) as document_id", "cast(null as string) as related_document_id",
        "element_at(array('SIRET_MISMATCH', 'TVA_INCOHERENCE', 'DATE_EXPIRED', 'MISSING_FIELD', 'FORMAT_ERROR', "
        "'KBIS_EXPIRED', 'URSSAF_EXPIRED'), cast(event_id % 7 as int) + 1) as type",
        "element_at(array('error', 'warning', 'info'), cast(event_id % 3 as int) + 1) as severity",
        "concat(event_type, ' ', event_id) as message",
        "case when event_id % 5 = 0 then map('field', 'x') when event_id % 5 = 1 then "
        "map('expiry_date', cast(date_add(date '2000-05-25', cast(event_id % 60 as int)) as string)) else "
        "map('date_expiration', cast(date_add(date '2000-05-25', cast(event_id % 60 as int)) as string)) end "
        "as details",
        "ts as detected_at", "event_id % 4 = 0 as resolved", "cast(null as timestamp) as resolved_at")


def status_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "concat('doc-', user_id) as document_id", "event_id", "cast(ts as timestamp) as ts",
        "case event_type when 'signup' then 'pending' when 'view' then 'ocr_done' when 'click' then 'classified' "
        "when 'purchase' then 'processed' else 'error' end as status")


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level recognition output of every text."""
    texts = spread(table(spark, sf_dir, "documents"), "doc_id")
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    words = lines.select("doc_id", "line", F.posexplode(F.split("l", " ")).alias("pos", "text"))
    return words.selectExpr(
        "concat('doc-', doc_id) as document_id", "1 as page", "1 as pass_no", "1 as block_num", "1 as par_num",
        "cast(line as int) as line_num", "cast(pos as int) as word_num", "text",
        "cast((doc_id * 7 + line * 11 + pos * 37) % 101 as double) as conf")


def ocr_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four recognition passes per text; a later pass loses its last characters."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('doc-', doc_id) as document_id", "1 as page", "explode(array(0, 1, 2, 3)) as pass_no", "doc_id", "text",
    ).selectExpr(
        "document_id", "page", "pass_no",
        "substr(text, 1, greatest(0, length(text) - 50 * pass_no)) as text",
        "((doc_id * 13 + pass_no * 29) % 100) / 100.0D as confidence",
        "concat('config-', pass_no) as ocr_config")


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as the recognised pages of a document."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('conv-', conv_id) as document_id", "cast(turn as int) as page", "text",
        "((conv_id + turn) % 100) / 100.0D as confidence", "concat('config-', turn % 4) as ocr_config",
        "case when (conv_id + turn) % 9 = 0 then 'trocr' else concat('strategy-', turn % 3) end as preprocessing_strategy")


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures of one page per text."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('doc-', doc_id) as document_id", "1 as page",
        "cast(doc_id * 7 % 160 as double) as blur_score", "cast(doc_id * 11 % 90 as double) as contrast_score",
        "cast(doc_id * 13 % 256 as double) as brightness", "cast(doc_id * 17 % 30 as double) as noise_score",
        "(doc_id * 19 % 40 - 20) / 10.0D as skew_angle", "cast(600 + doc_id * 23 % 1000 as int) as width",
        "cast(600 + doc_id * 29 % 1000 as int) as height")


def strategy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored preprocessing candidates; every thirteenth page has none that worked."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('doc-', doc_id) as document_id", "1 as page", "doc_id", "explode(array(0, 1, 2, 3)) as try_order",
    ).selectExpr(
        "document_id", "page", "try_order", "concat('strategy-', try_order) as strategy",
        "cast((doc_id * 31 + try_order * 57) % 40 as double) as sharpness",
        "((doc_id * 3 + try_order * 7) % 60) / 100.0D as black_ratio",
        "doc_id % 13 = 0 as all_failed")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts with a prediction from their length."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").selectExpr(
        "doc_id", "text", "cast(quality as int) as label", "cast(n_chars >= 200 as int) as prediction",
        "(doc_id % 100) / 100.0D as confidence")

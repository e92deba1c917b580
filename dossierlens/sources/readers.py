"""Readers of raw files and typed tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierlens import schemas
from dossierlens.functions import text as tx
from dossierlens.operators.ocr import MAX_RAW_BYTES

# Accepted file types.
MIME_BY_EXTENSION = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
    "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "txt": "text/plain",
}
UPLOAD_MIMES = ["application/pdf", "image/jpeg", "image/png", "image/tiff", "image/bmp"]


def mime_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    chain = F
    for ext, mime in MIME_BY_EXTENSION.items():
        chain = chain.when(extension == ext, F.lit(mime))
    return chain.otherwise(F.lit("application/octet-stream"))


# Spark lists a zone of many folders in up to this many tasks, 10,000 by default, each of them for a few folders only; tasks per core here.
LISTING_TASKS, LISTING_TASKS_PER_CORE = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 16


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path; they are listed here, not when they are read, so the setting is given back at once."""
    kept = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(kept), LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    finally:
        spark.conf.set(LISTING_TASKS, kept)


def read_raw(spark: SparkSession, path: str, accepted: list = None, max_bytes: int = MAX_RAW_BYTES):
    """``(accepted, rejected)`` files of the raw zone. The reason is decided from the path and length only, and a filter on
    the length is applied by the source before a file is opened."""
    files = _listed(spark, path)
    typed = files.withColumn("mime_type", mime_of(F.col("path")))
    known = F.col("mime_type").isin(UPLOAD_MIMES if accepted is None else accepted)
    fits = F.col("length") <= max_bytes
    reason = F.when(~known, F.lit("mime_type")).otherwise(F.lit("size"))
    return (
        typed.where(fits & known).select("path", "mime_type", "content", "length"),
        typed.where(~(fits & known)).select("path", "mime_type", "length", reason.alias("reason")),
    )


def decode_text(files: DataFrame) -> DataFrame:
    """Text files to recognition results: no recognition is needed, so the confidence is one."""
    valid = F.make_valid_utf8(F.col("content").cast("string"))
    return files.where(F.col("mime_type").startswith("text/")).withColumn(
        "text", tx.clean_ocr_text(valid)).select(
        "path", "text", F.lit(1.0).alias("confidence"), F.lit("plain_text").alias("method"),
        F.lit(None).cast("string").alias("ocr_config"), F.lit(1).alias("page_count"),
        tx.word_count(F.col("text")).alias("word_count"))


def _table(schema):
    def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
        return spark.read.schema(schema).format(fmt).load(path)
    return read


read_documents = _table(schemas.DOCUMENT)
read_suppliers = _table(schemas.SUPPLIER)
read_anomalies = _table(schemas.ANOMALY)
read_ocr_words = _table(schemas.OCR_WORD)
read_training_rows = _table(schemas.TRAINING_ROW)


def read_registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Responses of the company registry. A response that spans lines can only be read whole, by one task a file, which suits files
    of single responses; with ``lines`` a file holds one response per line and is split like any text."""
    return spark.read.schema(schemas.REGISTRY).option("multiLine", str(not lines).lower()).json(path)


def flatten_registry(registry: DataFrame) -> DataFrame:
    """One row per establishment: ``name, siret, siren, address``."""
    e = registry.select(F.explode("etablissements").alias("e"))
    unit, place = F.col("e.uniteLegale"), F.col("e.adresseEtablissement")

    def filled(c):
        return F.nullif(c, F.lit(""))

    person = F.trim(F.concat_ws(" ", unit["nomUniteLegale"], unit["prenom1UniteLegale"]))
    name = F.coalesce(
        filled(unit["denominationUniteLegale"]), filled(unit["denominationUsuelle1UniteLegale"]), filled(person),
        F.lit("ENTREPRISE INCONNUE"))
    street = F.concat_ws(" ", *[filled(place[c]) for c in (
        "numeroVoieEtablissement", "typeVoieEtablissement", "libelleVoieEtablissement")])
    address = F.concat(
        street, F.lit(", "), F.coalesce(place["codePostalEtablissement"], F.lit("")), F.lit(" "),
        F.coalesce(place["libelleCommuneEtablissement"], F.lit("")))
    return e.select(
        F.upper(name).alias("name"), F.col("e.siret").alias("siret"), F.col("e.siren").alias("siren"),
        F.regexp_replace(address, "^[, ]+|[, ]+$", "").alias("address"))

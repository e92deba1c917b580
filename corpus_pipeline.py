"""From documents to token ids: language, near-duplicates, benchmark passages, secrets, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; ``run`` writes each
result as Parquet in the shared working folder and reads it again as the next stage's documents. All but the last return the
columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlens.llm.bpe import encode_digests
from dossierlens.llm.decontaminate import find_contamination, judged
from dossierlens.llm.language import held_out, identify, train
from dossierlens.llm.near_duplicates import near_duplicates
from dossierlens.llm.secret_scan import redact, scan_secrets
from dossierlens.storage import stage

LEAST_CONFIDENCE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those no language explains better than all others together."""
    model = train(docs.where(~held_out()))
    found = identify(docs, model, output="__language", score="__score")
    return found.where((F.col("__language") != "und") & (F.col("__score") >= LEAST_CONFIDENCE)).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents linked at 0.8 on five-word shingles, once."""
    groups = near_duplicates(docs)
    kept = groups.where("id is null or id = component_id").select(F.col("id").alias("__id")).distinct()
    once = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    # Rows that share id and text are one document; of them the one whose other columns come first stays.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not others:
        return once.distinct()
    return once.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__rest")).select("doc_id", "text", "__rest.*").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents: at least a twentieth of the words inside 13-word windows of benchmark items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return judged(find_contamination(docs, benchmark)).where(~F.col("contaminated")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows where the text changed."""
    found = scan_secrets(docs, output="__secrets")
    masked = redact(found, spans="__secrets")
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.length("text")).otherwise(F.col("n_chars"))
                                   .cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of token ids and digests of ids and decoded text."""
    import public_tokenizers
    return encode_digests(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("text")


STAGES = [("language", language), ("near_duplicates", near_duplicate), ("decontamination", decontaminate), ("secrets", secrets), ("bpe", tokens)]
# Token ids and trained models are nothing that SQL can state; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language and bucket inside the tasks (one dense table per language and task), adds them up in
one grouped aggregation and brings languages x buckets counts to the driver, a size that does not depend on the number of
documents. The log-probabilities are broadcast and texts are scored in numpy, many at a time.

Defined results: null text, or text without a letter: language ``und``, score 0. Empty training table: every text is
``und``. Ties go to the language that sorts first. Documents with a null label do not train. Repeated rows are counted and
answered one by one. Existing columns named like the outputs are replaced; other columns pass through.
"""

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from dossierlens.llm.arrays import pieces

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
MAX_LANGUAGES = 1000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> code point of its lower case, or of a space where it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        if (char := chr(code)).isalpha():
            table[code] = ord(low) if len(low := char.lower()) == 1 else code
    return table


def gram_buckets(texts: list, sizes: tuple = SIZES, buckets: int = BUCKETS):
    """For each n: the bucket of the n-gram that starts at each character of the joined texts, and where each text begins.

    Upper case counts as lower case and all that is no letter as a space. Every text is followed by spaces, so no n-gram
    reaches into the next text; the last of these stand for the n-gram of spaces, whatever comes after them.
    """
    pad = max(sizes)
    joined = "".join([t + " " * pad for t in texts])
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.concatenate([[0], np.cumsum([len(t) + pad for t in texts])]).astype(np.int64)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    value = np.zeros(len(codes) + pad, np.uint32)
    blank = 0
    for size in range(1, pad + 1):
        factor = np.uint32(0x85EBCA6B * (2 * size - 1) ** 3 & 0xFFFFFFFF)
        value[: len(codes) - size + 1] += codes[size - 1:] * factor
        blank = (blank + 32 * int(factor)) & 0xFFFFFFFF
        if size in sizes:
            kept = value[: len(codes)].copy()
            for k in range(1, size):
                kept[starts[1:] - k] = np.uint32(blank)
            kept ^= kept >> np.uint32(15)
            kept *= np.uint32(0x9E3779B1) + np.uint32(2 * size)
            yield size, (kept >> shift).astype(np.int32), starts


@dataclass
class LanguageModel:
    """Languages in sorted order and log P(bucket | language) per n-gram bucket; ``prior`` is log P(language)."""

    languages: list
    logs: np.ndarray
    prior: np.ndarray
    sizes: tuple
    buckets: int

    def score(self, texts: list) -> np.ndarray:
        """Log-probability of each text under each language."""
        out = np.tile(self.prior, (len(texts), 1))
        for _, bucket, starts in gram_buckets(texts, self.sizes, self.buckets):
            for k in range(len(self.languages)):
                out[:, k] += np.add.reduceat(self.logs[k].take(bucket), starts[:-1], dtype=np.float64)
        return out


def train(labelled: DataFrame, text: str = "text", label: str = "lang", sizes: tuple = SIZES, buckets: int = BUCKETS,
          max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Fit on every row with a label. More than ``max_languages`` languages are refused, which bounds the model."""
    def counted(batches):
        tables, documents = {}, {}
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts, labels = piece.column("text").fill_null("").to_pylist(), np.asarray(piece.column("lang").to_pylist(), object)
                codes, inverse = np.unique(labels, return_inverse=True)
                for _, bucket, starts in gram_buckets(texts, sizes, buckets):
                    bucket += np.repeat((inverse * buckets).astype(np.int32), np.diff(starts))
                    found = np.bincount(bucket, minlength=len(codes) * buckets)
                    for k, code in enumerate(codes):
                        tables.setdefault(code, np.zeros(buckets, np.int64))
                        tables[code] += found[k * buckets: (k + 1) * buckets]
                for k, code in enumerate(codes):
                    documents[code] = documents.get(code, 0) + int((inverse == k).sum())
        for code, table in tables.items():
            used = np.flatnonzero(table)
            bucket, n = np.append(used, -1), np.append(table[used], documents[code])
            yield pa.RecordBatch.from_arrays(
                [pa.array([code] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())],
                names=["lang", "bucket", "n"])

    rows = labelled.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang"))
    # Before any count is made: each task holds a table per label it meets.
    if rows.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = (rows.mapInArrow(counted, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    table = counts.toPandas()  # at most languages x (buckets + 1) rows
    languages = sorted(table["lang"].unique())
    grams = np.zeros((len(languages), buckets))
    documents = np.ones(len(languages))
    place = {code: k for k, code in enumerate(languages)}
    of = table["lang"].map(place).to_numpy(dtype=np.int64)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    grams[of[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    documents[of[bucket < 0]] = n[bucket < 0]
    logs = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * buckets)).astype(np.float32)
    return LanguageModel(languages, logs, np.log(documents / documents.sum()) if languages else documents, sizes, buckets)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", output: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """All rows and columns plus the predicted language and the posterior probability of that language."""
    kept = docs.drop(output, score)
    schema = StructType([*kept.schema.fields, StructField(output, StringType()), StructField(score, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = "__has_letter"
    while letter in kept.columns:
        letter += "_"

    def predicted(batches):
        model = shared.value
        for batch in batches:
            for piece in pieces(batch, text):
                has = np.asarray(piece.column(letter).to_pylist(), bool)
                names, best = [UNDETERMINED] * len(has), np.zeros(len(has))
                rows = np.flatnonzero(has)
                if len(rows) and model.languages:
                    texts = piece.column(text).take(pa.array(rows)).to_pylist()
                    logs = model.score(texts)
                    top = logs.argmax(axis=1)
                    best[rows] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    for row, k in zip(rows, top):
                        names[row] = model.languages[k]
                columns = [piece.column(c) for c in range(piece.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(best)], names=schema.names)

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return kept.withColumn(letter, has_letter).mapInArrow(predicted, schema)


def held_out(doc_id: str = "doc_id"):
    """The documents that never train: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")

"""BPE encoding and decoding with a vocabulary that marks word ends, by a pair occurrence index.

Texts are normalised (NFC, lower case of each character), cut into words, and the words of a piece of the partition that are
not known yet are merged together: ``pair_index`` maps every pair to all its positions and applies active ranks in
ascending order. Word results are kept in a bounded table per worker.

Added tokens inside a text are one token each. Defined results: a null or empty text has no ids and decodes to the empty
text. Rows are encoded one by one; other columns pass through; columns named like the outputs are replaced.
"""

import hashlib
import struct
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from dossierlens.llm.arrays import pieces
from dossierlens.llm.pair_index import merge_words
from dossierlens.llm.vocabulary import vocabulary

# Fixed value: how the vocabulary cuts a normalised text into words; white space is dropped.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KEPT_WORDS, KEPT_LENGTH = 500_000, 40


def normalised(text: str) -> str:
    """NFC and lower case without regard to neighbours (a capital sigma is never a final sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Encoder:
    """Texts to ids, packed as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, path: str):
        self.vocab, self.cut, self.known = vocabulary(path), regex.compile(WORDS), {}

    def words(self, text: str) -> list:
        """Words of a text; added tokens stand in one-element tuples."""
        out = []
        for k, part in enumerate(self.vocab.parts(text)):
            if k % 2:
                out.append((part,))
            elif part:
                out += self.cut.findall(normalised(part))
        return out

    def encode(self, texts: list) -> list:
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known = {w: v for w, v in self.known.items() if type(w) is tuple}
        unknown = list({w: None for words in cut for w in words if w not in self.known})
        plain = [w for w in unknown if type(w) is str]
        fresh = {w: struct.pack(f"<{len(ids)}I", *ids) for w, ids in
                 zip(plain, merge_words([self.vocab.symbols(w) for w in plain], self.vocab.merges))}
        fresh |= {w: struct.pack("<I", self.vocab.added[w[0]]) for w in unknown if type(w) is tuple}
        self.known |= fresh
        out = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        for w in fresh:
            if type(w) is str and len(w) > KEPT_LENGTH:
                del self.known[w]
        return out

    def decode(self, packed: bytes) -> str:
        """Tokens joined by spaces, as the library does for a vocabulary without a decoder."""
        ids = memoryview(packed).cast("I") if struct.pack("=I", 1) == struct.pack("<I", 1) else struct.unpack(f"<{len(packed) // 4}I", packed)
        return " ".join(map(self.vocab.tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """All rows and columns plus ``ids`` (binary, little-endian unsigned 32 bit) and, if wanted, ``decoded``."""
    names = ["ids", *["decoded"] * decoded]
    kept = docs.drop(*names)
    schema = StructType([*kept.schema.fields, StructField("ids", BinaryType()), *[StructField("decoded", StringType())] * decoded])

    def encoded(batches):
        encoder = Encoder(path)
        for batch in batches:
            for piece in pieces(batch, text):
                ids = encoder.encode(piece.column(text).to_pylist())
                more = [pa.array([encoder.decode(x) for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(ids, pa.binary()), *more], names=schema.names)
    return kept.mapInArrow(encoded, schema)


def encode_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All rows and columns plus n_tokens, ids_sha256 and decoded_sha256, without moving ids out of the worker."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = docs.drop(*names)
    schema = StructType([*kept.schema.fields, StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                         StructField("decoded_sha256", StringType())])

    def digested(batches):
        encoder = Encoder(path)
        for batch in batches:
            for piece in pieces(batch, text):
                ids = encoder.encode(piece.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                     pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids])], names=schema.names)
    return kept.mapInArrow(digested, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")

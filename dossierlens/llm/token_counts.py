"""Token counts of a byte-level BPE vocabulary, with a shortcut for pre-tokens that are one token.

Before the job, it is proved which strings of the vocabulary encode alone as exactly one token: the string must be one
pre-token, and its bytes must merge to its own id. A matching pre-token then counts as one without merging; only other
pre-tokens are merged, and their counts are kept in a bounded table per worker. The proved strings are a part of the
vocabulary, so what is broadcast has its size.

Added tokens inside a text are one token each, as the tokenizers library has it by default. Defined results: null or empty
text has no tokens. Rows are counted one by one; other columns pass through; columns named like the outputs are replaced.
"""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dossierlens.llm.arrays import flat, pieces
from dossierlens.llm.pair_index import merge_word, merge_words
from dossierlens.llm.vocabulary import Vocabulary, byte_letters, vocabulary

# Fixed value: how byte-level vocabularies of this family cut a text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS, KEPT_LENGTH = 500_000, 40


def whole_tokens(vocab: Vocabulary) -> frozenset:
    """The strings of the vocabulary that encode alone as one token."""
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    cut = regex.compile(PRE_TOKENS)
    words, ids = [], []
    for token, number in vocab.ids.items():
        try:
            word = bytes(map(byte_of.__getitem__, token)).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if cut.findall(word) == [word]:
            words.append(word)
            ids.append(number)
    merged = merge_words([vocab.symbols(w) for w in words], vocab.merges)
    return frozenset(w for w, m, number in zip(words, merged, ids) if m == [number])


class Counter(dict):
    """Pre-token -> number of tokens; starts with the proved ones and merges what it does not know."""

    def __init__(self, vocab: Vocabulary, whole: frozenset):
        super().__init__(dict.fromkeys(whole, 1))
        self.vocab, self.whole, self.cut = vocab, whole, regex.compile(PRE_TOKENS)

    def __missing__(self, word: str) -> int:
        symbols = self.vocab.symbols(word)
        short = len(symbols) <= KEPT_LENGTH
        count = len(merge_word(symbols, self.vocab.merges) if short else merge_words([symbols], self.vocab.merges)[0])
        if short:
            if len(self) >= len(self.whole) + KEPT_WORDS:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[word] = count
        return count

    def count(self, text: str) -> int:
        parts = self.vocab.parts(text)
        return len(parts) // 2 + sum(sum(map(self.__getitem__, self.cut.findall(part))) for part in parts[::2])


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All rows and columns plus n_bytes and n_tokens; ``path`` is a byte-level BPE file that every executor can read."""
    kept = docs.drop("n_bytes", "n_tokens")
    schema = StructType([*kept.schema.fields, StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary(path)))

    def counted(batches):
        counter = Counter(vocabulary(path), whole.value)
        for batch in batches:
            for piece in pieces(batch, text):
                _, starts = flat(piece.column(text))
                n = [counter.count(t) if t else 0 for t in piece.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.diff(starts)), pa.array(n, pa.int64())],
                                                 names=schema.names)
    return kept.mapInArrow(counted, schema)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dossierlens.llm.bpe import Encoder, encode, encode_digests
from dossierlens.llm.pair_index import merge_word, merge_words
from dossierlens.llm.token_counts import Counter, count_tokens, whole_tokens
from dossierlens.llm.vocabulary import vocabulary

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
FIXED = [
    "", " ", "  two  spaces\n\n\ttab", "I'll don't WE'RE o'clock'd", "é é İstanbul ΣΑΣ ß ﬁ", "日本語テキスト 中文",
    "😀 👩‍👩‍👧 flags 🇫🇷", "a<|endoftext|>b <|startoftext|> <|endoftext|>", "<|endoftext", "x" * 5000, "ab" * 3000,
    " nbsp em​zero\u0085next\x1cfs\x00nul", "1234567890 ٣٤٥ Ⅷ ½", "aaaa aaaaa aaaaaa", "===---===... !!??", "﻿bom",
]


def texts():
    rng = random.Random(7)
    alphabet = "abcdeTHE  \n\t'.,-_019éÉñßσΣ中日ñ́ 😀<|>"
    return FIXED + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(400)]


def test_counts_match_library():
    library, vocab = Tokenizer.from_file(BYTE), vocabulary(BYTE)
    counter = Counter(vocab, whole_tokens(vocab))
    for text in texts():
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_whole_tokens_are_one_token():
    library, whole = Tokenizer.from_file(BYTE), sorted(whole_tokens(vocabulary(BYTE)))
    assert len(whole) > 40_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(whole, add_special_tokens=False))


def test_encoding_and_decoding_match_library():
    library, encoder = Tokenizer.from_file(WORD), Encoder(WORD)
    for text, packed in zip(texts(), encoder.encode(texts())):
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids, repr(text)
        assert encoder.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_merges_lowest_rank_first_in_any_order():
    # Rank 0 joins the product of rank 1, so it becomes active below the current rank.
    merges = {(9, 3): (0, 10), (1, 2): (1, 9), (3, 1): (2, 11)}
    assert merge_words([[1, 2, 3, 1, 2, 3], [], [3, 1, 2]], merges) == [[10, 10], [], [3, 9]]
    assert merge_word([1, 2, 3, 1, 2, 3], merges) == [10, 10] and merge_word([], merges) == []


@pytest.mark.parametrize("rows", [[], [(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "Hello world", None)]])
def test_frames(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counted = count_tokens(docs, BYTE).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in counted) == ([(1, 0, 0), (1, 0, 0), (2, 0, 0), (3, 11, 2)] if rows else [])
    digests = encode_digests(docs, WORD).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert [r.ids_sha256 == none for r in sorted(digests, key=lambda r: r.doc_id)] == ([True, True, True, False] if rows else [])
    assert {r.decoded for r in encode(docs, WORD).collect()} == ({"", "hello</w> world</w>"} if rows else set())

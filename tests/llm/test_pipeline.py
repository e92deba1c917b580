"""Language model, chat automaton and the whole pipeline against brute force; the package on workers started elsewhere."""

import collections
import hashlib
import math
import os
import re
import struct
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import SF, groups_of, lower
from test_secrets import KINDS, brute as secret_spans
from tokenizers import Tokenizer

from dossierlens.llm import catalog
from dossierlens.llm.decontaminate import find_contamination
from dossierlens.llm.language import BUCKETS, SIZES, gram_buckets, train
from dossierlens.llm.suffix_dedup import repeated_spans

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def documents(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def grams(text):
    """Bucket -> count of all hashed n-grams of a text."""
    counts = collections.Counter()
    for _, buckets, _ in gram_buckets([text], SIZES, BUCKETS):
        counts.update(buckets.tolist())
    return counts


def naive_bayes(rows):
    """Prediction function of a plain multinomial model with half a count added, learnt from (text, lang)."""
    counts, n = collections.defaultdict(collections.Counter), collections.Counter(lang for _, lang in rows)
    for text, lang in rows:
        counts[lang].update(grams(text or ""))
    totals = {lang: sum(c.values()) + 0.5 * BUCKETS for lang, c in counts.items()}

    def predict(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        own = grams(text)
        logs = {lang: math.log(n[lang] / len(rows)) + sum(k * math.log((c[b] + 0.5) / totals[lang]) for b, k in own.items())
                for lang, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())
    return predict


def learnt(rows):
    return naive_bayes([(t, lang) for d, t, lang in rows if lang is not None and zlib.crc32(str(d).encode()) % 4 != 2])


def test_language_query_is_naive_bayes(spark):
    rows = documents(spark)
    predict = learnt(rows)
    got = {r.doc_id: r for r in catalog.QUERIES["op10_language_id"](spark, SF).collect()}
    for d, text, _ in rows:
        lang, score = predict(text)
        assert got[d].lang_pred == lang and got[d].score == pytest.approx(score, abs=1e-3), d
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_too_many_languages_are_refused_before_counting(spark):
    rows = spark.range(30).select(F.lit("a").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError):
        train(rows, max_languages=20)


def contaminated(text, windows):
    words, hit = WORD.findall(lower(text)), set()
    for size in {len(w) for w in windows}:
        for k in range(len(words) - size + 1):
            if tuple(words[k:k + size]) in windows:
                hit |= set(range(k, k + size))
    return bool(hit) and 20 * len(hit) >= len(words)


def masked(text):
    out, done = "", 0
    for start, _, end in secret_spans(text):
        if start > done or start == done == 0:
            out += text[done:start] + "[SECRET]"
        done = max(done, end)
    return out + text[done:]


def test_pipeline_equals_brute_force(spark):
    sys.path.insert(0, ROOT)
    import corpus_pipeline
    rows = documents(spark)
    predict, windows = learnt(rows), set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = WORD.findall(lower(item.text))
        windows |= {tuple(words[k:k + min(13, len(words))]) for k in range(len(words) - min(13, len(words)) + 1)} if words else set()
    kept = [(d, t) for d, t, _ in rows if predict(t)[0] != "und" and predict(t)[1] >= 0.5]
    first = {d for d, (_, low) in groups_of(kept, 5).items() if d == low}
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for d, text in kept:
        if d in first and not contaminated(text, windows):
            ids = library.encode(masked(text), add_special_tokens=False).ids
            want[d] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                       hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 50 < len(want) < len(rows)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline
    clean = "the quick brown fox jumps over the lazy dog near the river bank every single day"
    rows = [(1, clean, "en", "s"), (1, clean, "en", "s"), (1, clean, None, "a"), (None, "another short english text about the weather", "en", "s"),
            (2, None, "en", "s"), (3, "", None, None), (4, clean + " token=abcdef123", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    stages = dict(corpus_pipeline.STAGES)
    out = {r.doc_id: r for r in stages["near_duplicates"](spark, docs, SF).collect()}
    assert stages["near_duplicates"](spark, docs, SF).count() == 4 + 1 and (out[1].lang, out[1].source) == ("en", "s") or out[1].source == "a"
    assert {r.doc_id for r in stages["decontamination"](spark, docs, SF).collect()} == {1, None, 2, 3, 4}
    hidden = {r.doc_id: r for r in stages["secrets"](spark, docs, SF).collect()}
    assert hidden[4].text == clean + " [SECRET]" and hidden[4].n_chars == len(clean) + 9 and hidden[2].text is None
    assert stages["bpe"](spark, docs, SF).count() == len(rows)
    none = {r.doc_id for r in stages["language"](spark, docs, SF).collect()}
    assert 2 not in none and 3 not in none


def test_columns_with_the_names_of_helpers(spark):
    docs = spark.createDataFrame([(1, "a b", "own", "x"), (2, "c d", "own", "y")], "doc_id long, text string, __row string, row_ string")
    bench = spark.createDataFrame([(1, "a b"), (2, "c d")], "item_id long, text string")
    for block in (1, 1000):
        found = find_contamination(docs, bench, block_words=block)
        assert sorted((r.doc_id, r["__row"], r["row_"], r.item_ids) for r in found.collect()) == [(1, "own", "x", ["1"]), (2, "own", "y", ["2"])]


def test_repeated_strings_beside_helper_names_and_nested_maps(spark):
    shared = "".join(chr(97 + k * k % 26) for k in range(300))
    docs = spark.createDataFrame([(1, "a" + shared, "own"), (2, shared + "b", "own"), (3, "alone", "own")], "doc_id long, text string, __key string").selectExpr(
        "*", "__key as __runs", "__key as __text", "array(map('a', doc_id)) as nested", "named_struct('m', map(1, 2)) as deep")
    got = {r.doc_id: r for r in repeated_spans(docs, length=100, gram=30).collect()}
    assert [bytes(got[k].kept) for k in (1, 2, 3)] == [b"a", b"b", b"alone"]
    assert all((r["__key"], r["__runs"], r["__text"], r.nested) == ("own", "own", "own", [{"a": r.doc_id}]) for r in got.values())


def test_suffix_query_equals_brute_force_on_whole_table(spark):
    rows = sorted((d, (t or "").encode()) for d, t, _ in documents(spark))
    seen = collections.Counter(b[k:k + 200] for _, b in rows for k in range(len(b) - 199))
    got = {r.doc_id: r for r in catalog.QUERIES["op1_suffix_dedup"](spark, SF).collect()}
    for d, body in rows:
        gone = bytearray(len(body))
        for k in range(len(body) - 199):
            if seen[body[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(body, gone) if not g)
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (len(body), sum(gone), hashlib.sha256(kept).hexdigest())
        assert got[d].n_spans == len(re.findall(b"\1+", bytes(gone)))


def test_token_queries_equal_the_library_on_whole_tables(spark):
    counts = {r.doc_id: r for r in catalog.QUERIES["op3_token_counts"](spark, SF).collect()}
    digests = {r.doc_id: r for r in catalog.QUERIES["op5_bpe"](spark, SF).collect()}
    library, words = (Tokenizer.from_file(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for d, text, _ in documents(spark):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (counts[d].n_bytes, counts[d].n_tokens, counts[d].over_limit) == (len((text or "").encode()), n, n > 512)
        ids = words.encode(text or "", add_special_tokens=False).ids
        assert (digests[d].n_tokens, digests[d].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert digests[d].decoded_sha256 == hashlib.sha256(words.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_secret_query_equals_expressions_on_the_whole_table(spark):
    got = {r.doc_id: r for r in catalog.QUERIES["op4_secret_scan"](spark, SF).collect()}
    for d, text, _ in documents(spark):
        base = [(s, k, e) for s, k, e in secret_spans(text or "") if k < 3]
        listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[d].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))


def test_nearest_query_recalls_on_the_whole_table(spark):
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(table))
    matrix, found, wanted = np.stack([table[i] for i in ids]), 0, 0
    got = collections.defaultdict(dict)
    for r in catalog.QUERIES["op6_nearest"](spark, SF).collect():
        got[r.query_id][r.vec_id] = r.score
    for q in ids[ids % 20 == 0]:
        scores = matrix @ table[q]
        best = [int(i) for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        found, wanted = found + len(set(best) & set(got[q])), wanted + len(best)
        assert len(got[q]) == len(best) and all(abs(s - float(table[v] @ table[q])) < 1e-9 for v, s in got[q].items())
    assert found >= 0.9 * wanted


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path / 'warehouse')!r}).getOrCreate()
print("rows", entry.queries()["op3_token_counts"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]

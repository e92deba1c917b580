"""The operators against brute force on the small tables, and their defined results on odd rows."""

import collections
import hashlib
import os
import random
import re
import sys
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

import compare
from dossierlens.llm import catalog
from dossierlens.llm.chat_format import format_chats, parse
from dossierlens.llm.components import connected_components
from dossierlens.llm.decontaminate import HIT_COLUMNS, find_contamination, judged
from dossierlens.llm.induced_sort import suffix_array
from dossierlens.llm.language import identify, train
from dossierlens.llm.near_duplicates import near_duplicates
from dossierlens.llm.nearest import nearest
from dossierlens.llm.suffix_dedup import owners, repeated_spans
from dossierlens.llm.url_filter import filter_urls

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = [(1, None, "en"), (2, "", "en"), (3, "?! 123", None), (4, "the cat and the dog", "en"), (4, "the cat and the dog", "en"),
       (5, "le chat et le chien", "fr"), (6, "x " * 30_000, "en")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumn("n", F.lit(1)).withColumn("score", F.lit("own"))


@pytest.mark.parametrize("name", sorted(catalog.CHECKS))
def test_sql(spark, name):
    assert compare.differences(spark, compare.connection(SF), SF, catalog.QUERIES[name], catalog.CHECKS[name]) == ""


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def groups_of(rows, size):
    sets, parent = {d: shingles(t, size) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = collections.defaultdict(list)
    for d in sorted(sets):
        common = collections.Counter(e for g in sets[d] for e in holders[g])
        for g in sets[d]:
            holders[g].append(d)
        for e, n in common.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates(spark, odd):
    truth = groups_of(documents(spark), 4)
    got = catalog.QUERIES["op8_near_duplicates"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == truth
    rows = sorted((r.id, r.n_shingles, r.component_id) for r in near_duplicates(odd).collect())
    assert rows == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4), (4, 1, 4), (5, 1, 5), (6, 1, 6)]
    assert near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_beyond_the_star(spark):
    """Copies edited at different places: pairs that no star compares must still be found."""
    rng = random.Random(5)
    base, rows = [f"w{k}" for k in range(120)], []
    for d in range(60):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(120)] = f"e{d}x{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == groups_of(rows, 4)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    parent = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {v: c for v, c in parent.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_decontamination(spark, odd):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    pattern, windows = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {}
    for item, text in items:
        words = pattern.findall(lower(text))
        size = min(13, len(words))
        for k in range(len(words) - size + 1):
            windows.setdefault(tuple(words[k:k + size]), set()).add(str(item))
    got = {r.doc_id: r for r in catalog.QUERIES["op7_decontamination"](spark, SF).collect()}
    for doc, text in documents(spark):
        words, hit, named = pattern.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if tuple(words[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    named |= windows[tuple(words[k:k + size])]
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        r = got[doc]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(words), len(hit), len(named), digest)
    bench = spark.createDataFrame([(1, "The CAT"), (2, None), (3, "..."), (4, "chien"), (1, "The CAT")], "item_id long, text string")
    whole = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in judged(find_contamination(odd, bench)).collect()}
    blocks = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in judged(find_contamination(odd, bench, block_words=1)).collect()}
    assert whole == blocks and whole[4] == (5, 2, ["1"], True) and whole[5] == (5, 1, ["4"], True) and whole[1] == (0, 0, [], False)
    assert find_contamination(odd, bench.limit(0)).where("size(item_ids) > 0").count() == 0


def test_decontamination_in_blocks_answers_every_row(spark):
    texts = ["The cat and the dog", "chien, the\tcat", "le chat", "the dog", None, "", "a the-cat chien b"]
    rows = [(None, t, "own") for t in texts] + [(7, t, "own") for t in texts] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(3)
    bench = spark.createDataFrame([(1, "The CAT"), (2, "..."), (3, "the dog"), (4, "chien"), (5, "cat-AND-the")], "item_id long, text string")

    def answers(**more):
        found = judged(find_contamination(docs, bench, **more))
        assert found.columns == ["doc_id", "text", "note", *HIT_COLUMNS.names, "n_hit", "n_items", "contaminated"]
        return sorted((tuple(r) for r in found.collect()), key=str)
    whole = answers()
    assert len(whole) == 21 and sum(r[0] is None and r[-1] for r in whole) == 4
    assert answers(block_words=1) == answers(block_words=4) == whole


def test_decontamination_by_a_large_benchmark(spark):
    """The join of fingerprints on the whole tables and on passages that very many rows and items share."""
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")

    def answers(docs, items, **more):
        return sorted((tuple(r) for r in judged(find_contamination(docs.select("doc_id", "text"), items, **more)).drop("text").collect()), key=str)
    assert answers(docs, items) == answers(docs, items, block_words=10)
    passage = " ".join(f"w{k}" for k in range(40))
    hot = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("x "), F.lit(passage), F.lit(" y"), "id").alias("text"))
    many = spark.range(40).select(F.col("id").alias("item_id"), F.concat(F.lit(passage + " z"), F.col("id") % 3).alias("text"))
    assert answers(hot, many) == answers(hot, many, block_words=10)


def test_language(spark, odd):
    got = catalog.QUERIES["op10_language_id"](spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    assert (truth.lang == truth.lang_pred)[truth.held_out].mean() > 0.95 and got.score.between(0, 1).all()
    model = train(odd.where("doc_id <> 6"))  # its single letters would outweigh all words
    rows = {r.doc_id: (r.lang_pred, r.score) for r in identify(odd, model).collect()}
    assert rows[1] == rows[2] == rows[3] == ("und", 0.0) and rows[4][0] == "en" and rows[5][0] == "fr"
    assert {r.lang_pred for r in identify(odd, train(odd.limit(0))).collect()} == {"und"}


def test_suffix_array():
    rng = np.random.default_rng(0)
    for trial in range(60):
        text = np.append(np.tile(rng.integers(1, 4, rng.integers(1, 30)), rng.integers(1, 5)), 0).astype(np.int32)
        tails = [text[k:].tolist() for k in range(len(text))]
        order, prefix = suffix_array(text, 5, memory=20 if trial % 2 else 1 << 20)
        assert order.tolist() == sorted(range(len(text)), key=tails.__getitem__)
        for a, b, n in zip(order, order[1:], prefix[1:]):
            assert tails[a][:n] == tails[b][:n] and tails[a][n:n + 1] != tails[b][n:n + 1]


def kept_bytes(bodies, length):
    seen, out = collections.Counter(b[k:k + length] for b in bodies for k in range(len(b) - length + 1)), []
    for b in bodies:
        gone = {j for k in range(len(b) - length + 1) if seen[b[k:k + length]] > 1 for j in range(k, k + length)}
        out.append(bytes(c for j, c in enumerate(b) if j not in gone))
    return out


def test_repeated_strings(spark):
    rng = random.Random(2)
    shared = ["".join(rng.choice("ab é") for _ in range(90)) for _ in range(3)]
    rows = [(k, "".join(rng.choice([rng.choice(shared), rng.choice(shared)[5:70], "".join(rng.choice("xyz") for _ in range(30))])
                        for _ in range(rng.randrange(0, 6))), "e") for k in range(40)] + [(40, None, "e"), (41, "", "e"), (42, "q" * 500, "e"), (43, "r" * 60, "e"), (43, "r" * 60, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    truth = sorted(zip([r[0] for r in rows], kept_bytes([(r[1] or "").encode() for r in rows], 50)))
    for shard in (1_000_000, 400):  # the small limit splits owners over shards
        got = repeated_spans(docs, length=50, gram=12, shard_bytes=shard).collect()
        assert sorted((r.doc_id, bytes(r.kept)) for r in got) == truth
    assert repeated_spans(docs.limit(0)).count() == 0
    named = docs.select("doc_id", F.lit(1).alias("key"), F.lit("x").alias("runs"), F.col("text").alias("spans"))
    got = repeated_spans(named, text="spans", length=50, gram=12).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == truth and {(r.key, r.runs) for r in got} == {(1, "x")}


def test_repeated_strings_of_a_split_owner(spark):
    length, gram, alphabet = 50, 12, "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    # The gram with the smallest hash of many owns every string that holds it.
    pool = noise(200_000)
    hashes = owners(np.frombuffer(pool.encode(), np.uint8), np.array([0, len(pool)]), gram, gram)[1].view(np.uint64)
    hot = pool[int(hashes.argmin()):][:gram]
    bodies = [noise(38) + hot + noise(38) for _ in range(60)]
    # Strings at several places of the owner, each alone, among two more and in the middle of a long segment.
    for before in (38, 30, 25, 13, 2, 0):
        string = noise(before) + hot + noise(length - gram - before)
        bodies += [string, noise(1) + string + noise(1), noise(38 - before) + string + noise(before)]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    truth = list(enumerate(kept_bytes([b.encode() for b in bodies], length)))
    assert sum(len(kept) < len(body) for (_, kept), body in zip(truth, bodies)) == 18
    for shard in (1_000_000, 2000, 500, 150, 20):  # one part, few, many, one string a part, and salted
        got = repeated_spans(docs, length=length, gram=gram, shard_bytes=shard).collect()
        assert sorted((r.doc_id, bytes(r.kept)) for r in got) == truth, shard


def test_nearest(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(600, 16)).astype(np.float32)
    vectors[100:300] = vectors[100]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0] * 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(table, table.where("vec_id % 20 = 0")).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got.query_id.nunique() == 30
    scores, found = vectors.astype(float) @ vectors.astype(float).T, 0
    for q, part in got.groupby("query_id"):
        best = sorted((k for k in range(600) if k != q), key=lambda k: (-scores[q, k].round(10), k))[:20]
        found += len(set(best) & set(part.vec_id))
        assert np.allclose(part.sort_values("rank").score, scores[q, part.sort_values("rank").vec_id])
    assert found >= 0.9 * 600
    few = nearest(table.where("vec_id < 5"), table.where("vec_id < 5")).count()
    assert few == 20 and nearest(table.limit(0), table).count() == 0


def test_nearest_bounds_both_sides(spark, monkeypatch, tmp_path):
    vectors = np.random.default_rng(6).normal(size=(400, 8)).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    asked = table.where("vec_id % 2 = 0")
    whole = sorted(tuple(r) for r in nearest(table, asked).collect())
    folder, apply = str(tmp_path), PandasCogroupedOps.applyInPandas

    def watched(self, function, schema):
        def noted(index, queries):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{len(queries)}")
            return function(index, queries)
        return apply(self, noted, schema)
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", watched)
    monkeypatch.setattr(sys.modules[nearest.__module__], "GROUP_ROWS", 50)
    got = sorted(tuple(r) for r in nearest(table, asked).collect())
    held = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert [r[:3] for r in got] == [r[:3] for r in whole] and 0 < max(held) < 100


def test_urls(spark):
    urls = ["http://A.net", "http://a.net/", "https://Sub.Example.NET/en/x?y=/fr/", "x://example.com/de/", "x://example.com/dede/", "notexample.com",
            None, "", "x://org/fr/", "x://a.org/fr/#z", "http://spam-farm.io/", "http://spamfarm.io/", "http://xexample.net/en/", "http://a.net/", "x://" + "a/" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(7)).withColumn("more", F.lit("m"))
    got = {r.page_id: (r.host[:20], r.path[:9], r.rule, r.verdict) for r in filter_urls(pages).collect()}
    assert got == {
        0: ("a.net", "", None, "allow"), 1: ("a.net", "/", "net/", "block"), 2: ("sub.example.net", "/en/x", "example.net/en/", "allow"),
        3: ("example.com", "/de/", "example.com/de/", "block"), 4: ("example.com", "/dede/", None, "allow"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("org", "/fr/", "org/fr/", "allow"), 9: ("a.org", "/fr/", "org/fr/", "allow"),
        10: ("spam-farm.io", "/", None, "block"), 11: ("spamfarm.io", "/", None, "allow"), 12: ("xexample.net", "/en/", "net/", "block"),
        13: ("a.net", "/", "net/", "block"), 14: ("a", "/a/a/a/a/", None, "allow")}
    assert filter_urls(pages.limit(0)).count() == 0 and {r.verdict for r in filter_urls(pages, ()).collect()} == {"allow"}


def test_chats(spark):
    rows = [(1, 0, "system", "be <b>~1~</b>"), (1, 1, "user", "<|end|>\n"), (1, 2, "assistant", None), (2, 0, "assistant", "x"), (3, None, None, ""),
            (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "u|<~r", "é😀")] + [(6, k, ["user", "assistant"][k % 2], "long " * 50) for k in range(500)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    got = {r.conv_id: r for r in format_chats(chats).withColumn("turns", parse(F.col("formatted"))).collect()}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.formatted == "".join(s.text for s in r.segments) and r.n_turns == len(own)
    assert [(c, got[c].valid, got[c].first_wrong_turn) for c in sorted(got)] == [
        (1, True, None), (2, False, 1), (3, False, 1), (4, False, 2), (5, False, 1), (6, True, None)]
    assert format_chats(chats.limit(0)).count() == 0


def test_pipeline(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    kept = set(rows)
    groups = collections.defaultdict(set)
    for d, (_, component) in groups_of(documents(spark), 5).items():
        groups[component].add(d)
    assert all(len(kept & g) <= 1 for g in groups.values())
    dirty = {r.doc_id for r in catalog.QUERIES["op7_decontamination"](spark, SF).collect() if r.contaminated}
    assert not kept & dirty and len(kept) > 0.7 * len(groups)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SF)
        assert out.columns == docs.columns and out.count() == 0


def test_near_duplicates_of_many_different_members(spark):
    """Very many texts share their rarest shingles and differ from each other: each block pair is compared, and no pair is lost."""
    rng = random.Random(8)
    base, rows = [f"w{k}" for k in range(100)], []
    for d in range(2000):
        words = list(base)
        for at in rng.sample(range(5, 95), 9 if d % 10 else 3):
            words[at] = f"e{d}x{at}"
        rows.append((d, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    sets = {d: shingles(t, 4) for d, t in rows if d % 10 == 0}
    assert len({r.component_id for r in got}) > 1500
    component = {r.id: r.component_id for r in got}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                assert component[a] == component[b]

"""Prefix trie, source divergence and source mix against brute force, on odd rows and on groups that spread over partitions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from dossierlens.llm import divergence as dv, prefix_trie as pt
from dossierlens.llm.mixing import mix_sources
from dossierlens.llm.running import MASK, running

EN = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_running_totals_of_groups_over_many_partitions(spark, many_partitions):
    random.seed(1)
    rows = [(random.choice([None, "hot", "hot", "hot", "a", ""]), k, random.choice([0, 5, MASK - 3, None])) for k in range(4000)]
    found = running(spark.createDataFrame(rows, "g string, k long, x long").repartition(5), ["g"], [F.col("k")], ["x"]).collect()
    want, seen = {}, collections.defaultdict(lambda: [0, 0])
    for g, k, x in rows:
        at = seen[g]
        at[1] = (at[1] + (x or 0)) & MASK
        want[k] = (at[0], at[1])
        at[0] += 1
    assert {r.k: (r.position, r.run_x) for r in found} == want and len(found) == len(rows)
    ranks = running(spark.createDataFrame(rows, "g string, k long, x long"), [], [F.col("k")])
    assert all(r.position == r.k for r in ranks.collect())


def trie(chats):
    """conversation -> list of (role, text); nodes by definition."""
    members = collections.defaultdict(list)
    for c in sorted(chats):
        for d in range(len(chats[c]) + 1):
            members[tuple(chats[c][:d])].append(c)
    below = {n: [m for m in members if m[:len(n)] == n] for n in members}
    out = []
    for n, own in members.items():
        ends = ",".join(str(c) for c in own if len(chats[c]) == len(n))
        parts = below[n]
        out.append((own[0], len(n), members[n[:-1]][0] if n else None, len(own), sum(len(m) == len(n) + 1 for m in parts),
                    sum(not any(len(x) == len(m) + 1 and x[:-1] == m for x in parts) for m in parts),
                    sum((len(members[m]) - 1) * len(m[-1][1]) for m in parts if m), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def nodes(frame):
    return sorted(tuple(r) for r in frame.select(*pt.NODE).collect())


CHATS = "conv_id long, turn long, role string, text string, position int, run_a string, depth string"


def spread(rows):
    return [(*r, 1, "a", None) for r in rows]


@pytest.mark.parametrize("cells", [1 << 6, pt.CELLS])
def test_trie_of_odd_conversations(spark, many_partitions, monkeypatch, cells):
    monkeypatch.setattr(pt, "CELLS", cells)
    random.seed(2)
    rows = [(c, t, random.choice(["user", None, ""]), random.choice(["a", "b", None, "é" * 70 + random.choice("xy")]))
            for c in (-205, -7, 0, 3, 5, 100, 101, 2**40, *range(200, 230)) for t in range(random.choice([1, 2, 3, 9]))]
    rows += [(5, None, "system", "late row first"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 0, "user", "nobody")]
    rows += [(999, 4, "user", "same")] * 300 + [(998, t, "user", "same") for t in range(300)]
    chats = collections.defaultdict(list)
    for c, t, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None),
                                   key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())):
        chats[c].append((role, text))
    frame = spark.createDataFrame(spread(rows), CHATS).repartition(4)
    assert nodes(pt.prefix_trie(frame)) == trie(chats)
    built = {}
    for c, own in chats.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = chats.get(base, [])[:h] + own[h:]
    assert nodes(pt.prefix_nodes(*pt.grafted(pt.describe_turns(frame)))) == trie(built)


def test_trie_without_rows_and_its_turns(spark):
    empty = spark.createDataFrame([], CHATS)
    assert nodes(pt.prefix_trie(empty)) == [] and nodes(pt.prefix_nodes(*pt.grafted(pt.describe_turns(empty)))) == []
    some = spark.createDataFrame(spread([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no")]), CHATS)
    turns = pt.node_turns(pt.prefix_trie(some), pt.describe_turns(some, keep=("role", "text")))
    assert sorted(tuple(r) for r in turns.collect()) == [(1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (2, 2, "assistant", "no")]


def audit(rows, top=200):
    docs = [(l or "", s or "", collections.Counter(EN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for l, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        of_lang = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for _, _, n in of_lang for t in n)
        kept = [t for t in df if df[t] >= 3]
        counts = {s: collections.Counter() for _, s, _ in of_lang}
        for _, s, n in of_lang:
            counts[s].update({t: n[t] for t in n if df[t] >= 3})
        total = sum(counts.values(), collections.Counter())

        def share(n):
            whole = sum(n.values()) + len(kept)
            return {t: 1 + 10**9 * (n[t] + 1) // whole for t in kept}
        p, q = {s: share(n) for s, n in counts.items()}, share(total)

        def f(a, b):
            return (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, o.decode(), -v, k + 1) for k, (v, o) in enumerate(found)]
    return sorted(out)


ODD = [("en", "a", None), (None, None, "the cat"), ("en", None, ""), ("en", "", "Cat cat"), ("de", "a", "?! 12"), ("de", "b", "x"), ("fr", "only", "le le le")]


@pytest.mark.parametrize("block", [3, dv.SOURCES])
def test_divergence_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(dv, "SOURCES", block)
    monkeypatch.setattr(dv, "TERMS", 2 if block == 3 else 2048)
    monkeypatch.setattr(dv, "PIECE_BYTES", 50)
    monkeypatch.setattr(dv, "FLUSH", 40)
    random.seed(3)
    vocabulary = ["the", "THE", "über", "naïve", "a" * 300 + "b", "a" * 300 + "c", "x" * 7, "x" * 13 + "é", "prefix", "prefixed", "prefixedlonger", "\x00nul"]
    rows = ODD + [(random.choice(["en", "en", None]), f"s{random.randrange(8)}", " ".join(random.choices(vocabulary, k=random.randrange(40)))) for _ in range(60)]
    rows += [("en", "hot", "the " * 3000 + "rare" * 40)] * 5
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, term int, position string").repartition(3)
    found = sorted(tuple(r) for r in dv.divergence(frame).select("lang", "source", "part", "item", "value", "rank").collect())
    assert found == audit(rows)
    assert sorted(tuple(r)[3:] for r in dv.divergence(frame, top=2).where("part = 'term'").collect()) == sorted(r[3:] for r in audit(rows, 2) if r[2] == "term")


def test_divergence_of_an_empty_table_and_without_kept_terms(spark):
    schema = "lang string, source string, text string"
    assert dv.divergence(spark.createDataFrame([], schema)).collect() == []
    rows = [("en", "a", "once"), ("en", "b", "twice"), ("en", "c", None)]
    assert sorted(tuple(r) for r in dv.divergence(spark.createDataFrame(rows, schema)).collect()) == audit(rows)


def test_prefix_hash_is_that_of_spark(spark):
    words = ["", "a", "übergrößen", "x" * 40]
    for lang, word in itertools.product(["", "en", "日本"], words):
        got = spark.range(1).select(F.xxhash64(F.lit(lang), F.lit(word).cast("binary"))).first()[0]
        assert got % 2**64 == dv.prefix_hash(lang.encode(), word.encode())


DOCS = "doc_id long, source string, text string, position int, size string, target string"


def mixed(spark, rows, **options):
    return mix_sources(spark.createDataFrame([(*r, 1, "s", None) for r in rows], DOCS).repartition(3), **options)


def test_mix_follows_the_queue(spark, many_partitions):
    random.seed(4)
    rows = [(k, random.choice(["hot"] * 5 + [None, "", "a", "é", "z"]), "w " * random.randrange(30)) for k in range(600)]
    rows += [(None, "a", "null id"), (7, "a", "same"), (7, "a", "same"), (600, "empty", None), (601, "empty", " \t\n"), (602, "long", "word\x0b" * 4000)]
    found = mixed(spark, rows).collect()
    again = mixed(spark, rows[::-1]).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    size = {s: sum(len(re.findall("[^\x20\x09-\x0D]+", t or "")) for _, x, t in rows if x == s) for s in {r[1] for r in rows}}
    order = sorted((s for s in size if s is not None), key=str.encode) + [None]
    weight, open_, target, budget = {s: k % 3 + 1 for k, s in enumerate(order)}, set(order), {}, sum(size.values())
    while True:
        share = {s: (budget - sum(3 * size[x] for x in order if x not in open_)) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * size[s]}
        if not above:
            break
        open_ -= above
    target = {s: share[s] if s in open_ else 3.0 * size[s] for s in order}
    taken = collections.Counter()
    for r in found:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12) and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    longest = {s: max(r.size for r in found if r.source == s) for s in order}
    assert sum(taken.values()) <= budget
    for s in order:
        assert abs(taken[s] - target[s]) <= longest[s]
    assert taken["empty"] == 0


def test_mix_limits(spark):
    assert mixed(spark, []).collect() == []
    assert [r.copies for r in mixed(spark, [(1, "a", "one two")]).collect()] == [1]
    assert {r.copies for r in mixed(spark, [(k, "ab"[k % 2], "w " * k) for k in range(1, 9)], percent=1000).collect()} == {3}
    assert {r.copies for r in mixed(spark, [(1, None, None), (2, "a", "")]).collect()} == {0}

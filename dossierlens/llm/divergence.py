"""Source divergence audit: which terms, and which other sources, set a source apart from the rest of its language.

Kept terms (those in at least ``min_docs`` documents of a language) are found by iceberg prefix refinement. Level 1 counts, per
language, the documents that hold each prefix of ``FIRST`` bytes, and whole terms up to that length. The next level extends only
prefixes that reached the threshold, to three times the length, and so on until no incomplete prefix is left. A prefix is in at least as
many documents as each of its terms, so a term whose prefix fails is never counted: the many rare long terms of a large corpus
leave the tasks as short prefixes only. Counts are added up inside the tasks (flushed beyond ``FLUSH`` entries), whole terms also
per source, so that the level that completes a term gives its occurrences. They are shuffled packed, many terms in a row, by
language and a hash bucket of the term, and added up per bucket; the buckets grow in number with the documents.

The surviving prefixes go to the next level as a bit set of at most ``BITS`` bits (16 MB). Where two prefixes share a bit, terms
of a failed one are counted as well; the exact count of whole terms decides in any case, so this costs time only.

With p and q per mille of a million (integers, add-one smoothed), f = floor((p - q)^2 / q). The sum of f over all kept terms for
each ordered pair of sources is the value for two absent counts, times the number of terms, plus corrections where a count is
present. Corrections are made per block of about ``TERMS`` terms and block of ``SOURCES`` times ``SOURCES`` sources in numpy,
in two halves so that 64 bits suffice. The result has a row for each pair of sources, as asked for; nothing else is quadratic.

Defined results: null text, language and source are the empty string, each row is a document (repeated rows count). A group
without terms has all its pairs; a language without kept terms has value 0 for all pairs and no terms. Empty table: no rows.
Other columns are not read, whatever their names. Texts of any length are read in pieces, cut between terms; the distinct terms
of one document are held in memory.
"""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from dossierlens.llm.running import running
from dossierlens.storage import stage

FIRST, STEP, MIN_DOCS, TOP = 8, 3, 3, 200
BITS = 1 << 27
FLUSH, PIECE_BYTES, BUCKET_DOCS = 400_000, 1 << 20, 16_000
TERMS, SOURCES = 2048, 256
SCALE = 1_000_000_000
# Bytes of terms: letters, in lower case, and all of non-ASCII characters; the rest separates.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_pieces(text: bytes):
    """The terms of a text, as lists of those of about a megabyte each."""
    plain, at = text.translate(TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def prefix_hash(lang: bytes, prefix: bytes) -> int:
    """What xxhash64(lang, prefix) is in Spark."""
    return xxhash.xxh64_intdigest(prefix, xxhash.xxh64_intdigest(lang, 42))


COUNTS = "lang string, bucket int, kind int, source string, terms binary, counts binary"
# What a packed row counts: documents with a whole term, documents with a longer term of this prefix, occurrences in a source.
TERM_DOCS, PREFIX_DOCS, OCCURRENCES = 0, 1, 2


def _counted(shortest: int, longest: int, alive, buckets: int):
    """Counts the terms of more than ``shortest`` bytes whose prefix of that length is alive: whole up to ``longest`` bytes, else
    their prefix of that length. Rows are packed: all terms of a language, bucket, kind and source of a task's turn in one."""
    names = ["lang", "bucket", "kind", "source", "terms", "counts"]

    def local(batches):
        docs, occurrences, prefixes = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
        living, dead = defaultdict(set), defaultdict(set)
        bits = alive.value if alive else None

        def screened(lang, terms):
            """The terms whose prefix is not known to be in too few documents."""
            live, gone = living[lang], dead[lang]
            begins = {t[:shortest] for t in terms}
            for prefix in begins - live - gone:
                at = prefix_hash(lang, prefix) % (len(bits) * 64)
                (live if int(bits[at >> 6]) >> (at & 63) & 1 else gone).add(prefix)
            lost = begins & gone
            return [t for t in terms if t[:shortest] not in lost] if lost else terms

        def out():
            for kind, tables in ((TERM_DOCS, docs), (PREFIX_DOCS, prefixes), (OCCURRENCES, occurrences)):
                for key, seen in tables.items():
                    lang, source = key if kind == OCCURRENCES else (key, None)
                    parts = defaultdict(list)
                    for t in seen:
                        if len(t) <= longest:
                            parts[zlib.crc32(t) % buckets].append(t)
                    rows = list(parts.items())
                    if rows:
                        yield pa.RecordBatch.from_arrays([
                            pa.array([lang.decode()] * len(rows), pa.string()), pa.array([number for number, _ in rows], pa.int32()),
                            pa.array([kind] * len(rows), pa.int32()), pa.array([None if source is None else source.decode()] * len(rows), pa.string()),
                            pa.array([b" ".join(terms) for _, terms in rows], pa.binary()),
                            pa.array([np.array([seen[t] for t in terms], np.int64).tobytes() for _, terms in rows], pa.binary())], names=names)

        for batch in batches:
            for lang, source, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                lang, source = lang.encode(), source.encode()
                total, distinct = occurrences[lang, source], set()
                for terms in term_pieces(text):
                    if shortest:
                        terms = screened(lang, [t for t in terms if len(t) > shortest])
                    total.update(terms)
                    distinct.update(terms)
                # Longer terms are counted as well, which is cheaper than to sort them out here, and left behind in out().
                docs[lang].update(distinct)
                prefixes[lang].update({t[:longest] for t in distinct if len(t) > longest})
            if sum(map(len, occurrences.values())) + sum(map(len, docs.values())) + sum(map(len, prefixes.values())) > FLUSH:
                yield from out()
                docs.clear(), occurrences.clear(), prefixes.clear()
            if sum(map(len, living.values())) + sum(map(len, dead.values())) > FLUSH:
                living.clear(), dead.clear()
        yield from out()
    return local


def _merged(min_docs: int):
    """Adds up packed rows that arrive in order of (lang, bucket) and unpacks what is in enough documents: terms with their
    occurrences per source and in the language, and prefixes (source null)."""
    names = ["lang", "source", "term", "whole", "n", "lang_n", "lead"]

    def merge(batches):
        now, tables, occurrences = None, (Counter(), Counter()), defaultdict(Counter)

        def out():
            lang = now[0]
            kept = {t for t, n in tables[TERM_DOCS].items() if n >= min_docs}
            total, led = Counter(), set()
            for found in occurrences.values():
                for t, n in found.items():
                    if t in kept:
                        total[t] += n
            for source, found in sorted(occurrences.items()):
                terms = [t for t in found if t in kept]
                lead = [t not in led for t in terms]
                led.update(terms)
                yield rows(lang, source, terms, True, [found[t] for t in terms], [total[t] for t in terms], lead)
            alive = [t for t, n in tables[PREFIX_DOCS].items() if n >= min_docs]
            yield rows(lang, None, alive, False, [None] * len(alive), [None] * len(alive), [None] * len(alive))

        def rows(lang, source, terms, whole, n, lang_n, lead):
            k = len(terms)
            return pa.RecordBatch.from_arrays([
                pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(terms, pa.binary()), pa.array([whole] * k, pa.bool_()),
                pa.array(n, pa.int64()), pa.array(lang_n, pa.int64()), pa.array(lead, pa.bool_())], names=names)

        for batch in batches:
            for lang, bucket, kind, source, terms, counts in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                if (lang, bucket) != now:
                    if now:
                        yield from out()
                    now, tables, occurrences = (lang, bucket), (Counter(), Counter()), defaultdict(Counter)
                table = occurrences[source] if kind == OCCURRENCES else tables[kind]
                add = dict(zip(terms.split(b" "), np.frombuffer(counts, np.int64).tolist()))
                table.update(add) if table else dict.update(table, add)
        if now:
            yield from out()
    return merge


def _alive(prefixes: DataFrame):
    """The bit set of the given prefixes as a broadcast; None if there are none."""
    n = prefixes.count()
    if not n:
        return None
    bits = min(BITS, max(1 << 16, 1 << (8 * n).bit_length()))
    # A power of two, so that pmod of the signed and the unsigned hash agree.
    words = (prefixes.select(F.pmod(F.xxhash64("lang", "term"), F.lit(bits)).alias("at"))
             .groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow())
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return prefixes.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, first: int = FIRST) -> DataFrame:
    """lang, source, term, n (occurrences there), lang_n (in the language), lead (one row per language and term) of all terms kept.
    ``docs``: lang, source, text without nulls."""
    buckets = 1 << max(6, (docs.count() // BUCKET_DOCS).bit_length())
    shortest, longest, alive, whole = 0, first, None, None
    while True:
        packed = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(_counted(shortest, longest, alive, buckets), COUNTS)
        level = stage(packed.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(
            _merged(min_docs), "lang string, source string, term binary, whole boolean, n long, lang_n long, lead boolean"), f"level_{longest}")
        terms = level.where("whole").drop("whole")
        whole = terms if whole is None else whole.unionByName(terms)
        alive = _alive(level.where("not whole").select("lang", "term"))
        if alive is None:
            return whole.withColumn("term", F.col("term").cast("string"))
        shortest, longest = longest, STEP * longest


def _share(n: str, total: str) -> str:
    return f"cast(1 + (cast({SCALE} as decimal(38,0)) * ({n} + 1)) div (cast({total} as decimal(38,0)) + v) as long)"


SCORE = "((p - q) * (p - q)) div q"


def _pair_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """For one block of terms and two blocks of sources: the sum of f over the terms that occur in either, in two halves."""
    lang, block_a, block_b = rows["lang"].iat[0], rows["a"].iat[0], rows["b"].iat[0]
    present = rows[rows["term"].notna()]
    terms = pd.factorize(present["term"])[0]
    count = int(terms.max()) + 1 if len(terms) else 0
    sides = []
    for block in (block_a, block_b):
        anchors = rows[rows["term"].isna() & (rows["block"] == block)].sort_values("position")
        table = np.tile(anchors["p"].to_numpy(np.int64), (count, 1))
        own = (present["block"] == block).to_numpy()
        table[terms[own], np.searchsorted(anchors["position"].to_numpy(), present["position"].to_numpy()[own])] = present["p"].to_numpy(np.int64)[own]
        sides.append((anchors["position"].to_numpy(np.int64), table))
    (left, p), (right, q) = sides
    high, low = np.zeros((len(left), len(right)), np.int64), np.zeros((len(left), len(right)), np.int64)
    for k in range(len(left)):
        d = p[:, k: k + 1] - q
        f = d * d // q
        high[k], low[k] = (f >> 30).sum(axis=0), (f & ((1 << 30) - 1)).sum(axis=0)
    return pd.DataFrame({"lang": lang, "i": np.repeat(left, len(right)), "j": np.tile(right, len(left)), "high": high.ravel(), "low": low.ravel(),
                         "terms": count})


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    terms = kept_terms(plain, min_docs)
    occurring = plain.select("lang", "source").distinct()
    by_group = terms.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    by_lang = terms.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("all_n"))
    groups = occurring.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0, ["own_n", "v", "all_n"])
    groups = stage(running(groups, ["lang"], [F.col("source")], [], "lang_sources").withColumn(
        "absent", F.when(F.col("v") > 0, F.expr(_share("0", "own_n")))), "divergence_groups")

    placed = terms.join(groups, ["lang", "source"])
    scored = placed.select("lang", "source", F.col("term").alias("item"), F.expr(_share("n", "own_n")).alias("p"), F.expr(_share("lang_n", "all_n")).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_part = (scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr(SCORE).alias("value"))
                 .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))

    block = F.expr(f"position div {SOURCES}")
    pieces = F.expr(f"v div {TERMS} + 1")
    last = groups.groupBy("lang").agg((F.max("position")).alias("last")).select("lang", F.expr(f"last div {SOURCES}").alias("last"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda k: k)
    pairs_of = F.array_distinct(F.concat(F.transform(others, lambda k: F.struct(F.col("block").alias("a"), k.alias("b"))),
                                         F.transform(others, lambda k: F.struct(k.alias("a"), F.col("block").alias("b")))))
    present = placed.select("lang", F.expr(f"pmod(xxhash64(term), {'v div ' + str(TERMS) + ' + 1'})").alias("piece"), "term", "position", block.alias("block"),
                            F.expr(_share("n", "own_n")).alias("p"))
    anchors = groups.where("v > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"),
                                           F.lit(None).cast("string").alias("term"), "position", block.alias("block"), F.col("absent").alias("p"))
    cells = present.unionByName(anchors).join(last, "lang").withColumn("pair", F.explode(pairs_of)).select(
        "lang", "piece", "pair.a", "pair.b", "term", "position", "block", "p")
    sums = (cells.groupBy("lang", "piece", "a", "b").applyInPandas(_pair_sums, "lang string, i long, j long, high long, low long, terms long")
            .groupBy("lang", "i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "terms")]))
    one = groups.select("lang", "source", "v", F.col("position").alias("i"), F.col("absent").alias("p"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("position").alias("j"), F.col("absent").alias("q"))
    value = F.expr(f"cast(coalesce(high * {1 << 30} + low + (v - terms) * ({SCORE}), 0) as long)")
    pair_part = (one.join(two, "lang").where("i <> j").join(sums, ["lang", "i", "j"], "left")
                 .select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order)))
    return pair_part.unionByName(term_part)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
counts AS (SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(terms) AS term FROM words) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING count(*) >= 3),
langs AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM words) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
here AS (SELECT c.lang, c.source, c.term, sum(c.n) AS n FROM counts c JOIN kept k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
groups_ AS (SELECT w.lang, w.source, (SELECT v FROM langs l WHERE l.lang = w.lang) AS v, (SELECT n FROM langs l WHERE l.lang = w.lang) AS lang_n, coalesce(sum(h.n), 0) AS n
            FROM (SELECT DISTINCT lang, source FROM words) w LEFT JOIN here h ON h.lang = w.lang AND h.source = w.source GROUP BY w.lang, w.source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
                  (1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (g.n + g.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.n + 1)) // (g.lang_n + g.v))::BIGINT AS q
           FROM groups_ g JOIN kept k ON k.lang = g.lang LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, (SELECT coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term
                  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source)::BIGINT AS value
          FROM groups_ a JOIN groups_ b ON b.lang = a.lang AND b.source <> a.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= 200
"""

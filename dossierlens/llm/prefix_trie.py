"""Trie of conversation prefixes: every distinct sequence of first turns is a node, found without shuffling all prefixes.

1. Every turn becomes two 60-bit halves of a SHA-256 digest of role and text plus its length; of the text itself only the first
   64 characters travel, which order turns of equal number.
2. The digest of a prefix is the sum, modulo 2^62, of hashes of (turn digest, depth), twice over. Sums can be made for a
   conversation that spreads over many partitions (``running``), and a prefix's sum without its last turn is its parent's.
3. Count-min screening: each prefix digest counts in one cell of each of two rows; a bit per cell says whether it was counted
   twice. If a bit of a prefix, or of its parent, is not set, its estimate is one, and it is proved to belong to one conversation.
   Such tails are complete nodes as they are and are emitted where they lie; only a tail's first node asks for its parent.
4. Possibly shared prefixes are grouped exactly by digest. A conversation that is the smallest of a node is so in all deeper nodes
   on its path, so subtree sums need no walk over levels: for each conversation, the turns that it does not represent (as a
   length) and whether it represents a childless node are two numbers, which its shared prefixes add up. For a node, the
   turns of members below it, less those of the distinct nodes there, are the tokens saved.

The sketch has at most ``CELLS`` bits in each row (16 MB in all, the only broadcast that depends on rows); beyond that more
prefixes count as possibly shared and are grouped exactly, with the same result. Groups are counted before the shuffle. The ids
that end in a node are put together in sorted chunks by range, so the digest of a node reads a few chunks, in order, not rows.

Defined results: turns are ordered by turn (null first), then role, the first 64 characters of the text and its digest; repeated
rows are turns of their own. Null role and text are empty. Rows of null conversation id belong to no conversation. Empty table:
no nodes, not even the root. Other columns are not part of the result, whatever their names.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dossierlens.llm.running import MASK, running
from dossierlens.storage import stage

CELLS = 1 << 26
CHUNK_IDS = 100_000
NO_IDS = hashlib.sha256(b"").hexdigest()
ROOT = -1


def describe_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   keep: tuple = ()) -> DataFrame:
    """conv_id, u, v (digest), chars and position (from 0) of every turn; ``keep`` may name "role" and "text" to have them too."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"), 256)
    slim = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), F.left(text_, F.lit(64)).alias("lead"),
        *[F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(half) for half, at in (("u", 1), ("v", 16))],
        F.length(text_).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"), *([text_.alias("text")] if "text" in keep else []))
    order = [F.col("turn").asc_nulls_first(), *[F.col(c) for c in ("role", "lead", "u", "v", "row")]]
    return running(slim, ["conv_id"], order, [], "trie_turns").select("conv_id", "u", "v", "chars", "position", *keep)


def _screened(rows: DataFrame) -> DataFrame:
    """Adds ``shared`` and ``parent_shared``: false where the sketch proves that one conversation has the prefix."""
    n = rows.count()
    cells = min(CELLS, max(1 << 16, 1 << (4 * n).bit_length()))

    def cell(a, b, k):
        return F.pmod(F.xxhash64(F.col(a), F.col(b), F.lit(k)), F.lit(cells)) + F.lit(k * cells)
    crowded = (rows.select(F.explode(F.array(*[cell("run_a", "run_b", k) for k in (0, 1)])).alias("cell"))
               .groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
               .groupBy(F.expr("cell div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("bits")).toArrow())
    table = np.zeros(2 * cells // 64, np.int64)
    table[crowded.column("word").to_numpy()] = crowded.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(table)
    names = ["c0", "c1", "p0", "p1"]

    def screened(batches):
        bits = shared.value
        for batch in batches:
            hit = []
            for name in names:
                at = batch.column(batch.schema.get_field_index(name)).to_numpy()
                hit.append((bits[at >> 6] >> (at & 63)) & 1 != 0)
            top = batch.column(batch.schema.get_field_index("depth")).to_numpy() == 1
            above = (hit[2] & hit[3]) | top
            kept = batch.drop_columns(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hit[0] & hit[1] & above), pa.array(above)],
                                             names=[*kept.schema.names, "shared", "parent_shared"])

    schema = ", ".join([f"{name} {kind}" for name, kind in rows.dtypes] + ["shared boolean", "parent_shared boolean"])
    return rows.withColumns({name: cell(a, b, k) for name, (a, b, k) in zip(names, (
        ("run_a", "run_b", 0), ("run_a", "run_b", 1), ("pa", "pb", 0), ("pa", "pb", 1)))}).mapInArrow(screened, schema)


def _id_digests(ends: DataFrame) -> DataFrame:
    """run_a, run_b, ends_sha256 of the ids that end there, ascending; the rows of a node are joined in sorted chunks first."""
    key = ["run_a", "run_b"]

    def chunks(batches):
        now, ids = None, []

        def out():
            return pa.RecordBatch.from_pydict({"run_a": [now[0]], "run_b": [now[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})
        for batch in batches:
            for a, b, c in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if (a, b) != now or len(ids) >= CHUNK_IDS:
                    if ids:
                        yield out()
                    now, ids = (a, b), []
                ids.append(c)
        if ids:
            yield out()

    def digests(batches):
        now, digest = None, None
        for batch in batches:
            for a, b, _, ids in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if (a, b) == now:
                    digest.update(b",")
                else:
                    if now:
                        yield pa.RecordBatch.from_pydict({"run_a": [now[0]], "run_b": [now[1]], "ends_sha256": [digest.hexdigest()]})
                    now, digest = (a, b), hashlib.sha256()
                digest.update(ids.encode())
        if now:
            yield pa.RecordBatch.from_pydict({"run_a": [now[0]], "run_b": [now[1]], "ends_sha256": [digest.hexdigest()]})

    joined = (ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
              .mapInArrow(chunks, "run_a long, run_b long, first long, ids string"))
    return joined.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digests, "run_a long, run_b long, ends_sha256 string")


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: smallest conversation, depth, the parent's smallest conversation, conversations, children, childless nodes
    of the subtree, saved code points of the subtree, digest of the conversations that end here.

    ``turns``: conv_id, depth (from 1), u, v, chars, length (turns of the conversation). ``lengths``: conv_id, length of all
    conversations, also those without turns.
    """
    spark = turns.sparkSession
    hashed = turns.select("conv_id", "depth", "length", "chars", *[
        F.xxhash64(half, "depth").bitwiseAND(F.lit(MASK)).alias(name) for name, half in (("a", "u"), ("b", "v"))])
    summed = running(hashed, ["conv_id"], [F.col("depth")], ["a", "b", "chars"], "trie_prefixes")
    rows = stage(_screened(summed.select(
        "conv_id", "depth", "length", "chars", "run_a", "run_b", "run_chars", (F.col("run_a") - F.col("a")).bitwiseAND(F.lit(MASK)).alias("pa"),
        (F.col("run_b") - F.col("b")).bitwiseAND(F.lit(MASK)).alias("pb"))), "trie_screened")
    key, parent = ["run_a", "run_b"], ["pa", "pb"]
    ends_here = F.col("depth") == F.col("length")
    shared, tails = rows.where("shared"), rows.where("not shared")
    grouped = stage(shared.groupBy(*key).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("chars").alias("chars"),
        F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.count_if(ends_here).alias("n_ends")), "trie_groups")
    childless = F.col("n_convs") == F.col("n_ends")
    tops = tails.where("parent_shared and depth > 1")
    children = (grouped.where("depth > 1").select(*parent, F.lit(1).cast("long").alias("n"))
                .unionByName(tops.groupBy(*parent).agg(F.count("*").alias("n")))
                .groupBy(F.col("pa").alias("run_a"), F.col("pb").alias("run_b")).agg(F.sum("n").alias("n_children")))
    # Per conversation: code points of the turns that another conversation represents, and whether it represents a childless node.
    stands_for = stage(
        shared.select("conv_id", "chars", F.lit(0).alias("leaf"))
        .unionByName(grouped.select("conv_id", (-F.col("chars")).alias("chars"), F.when(childless, 1).otherwise(0).alias("leaf")))
        .unionByName(tails.where(ends_here).select("conv_id", F.lit(0).cast("long").alias("chars"), F.lit(1).alias("leaf")))
        .groupBy("conv_id").agg(F.sum("chars").alias("others"), F.sum("leaf").alias("leaves")), "trie_conversations")
    before = F.col("run_chars") - F.col("chars")
    below = (shared.select("conv_id", *key, before.alias("before")).join(stands_for, "conv_id").groupBy(*key).agg(
        F.sum(F.greatest(F.lit(0), F.col("others") - F.col("before"))).alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))
    without_turns = lengths.where("length = 0").select(*[F.lit(ROOT).cast("long").alias(k) for k in key], "conv_id")
    digests = stage(_id_digests(shared.where(ends_here).select(*key, "conv_id").unionByName(without_turns)), "trie_ends")

    everyone = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).first()
    if not everyone["n"]:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE))
    sums = stands_for.agg(F.sum("leaves").alias("leaves"), F.sum("others").alias("others")).first()
    first_level = grouped.where("depth = 1").count() + tails.where("depth = 1").count()
    at_root = digests.where(F.col("run_a") == ROOT).first()
    root = spark.createDataFrame([(everyone["low"], 0, None, everyone["n"], first_level, (sums["leaves"] or 0) or 1, sums["others"] or 0,
                                   at_root["ends_sha256"] if at_root else NO_IDS)], ", ".join(
        f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE))

    parents = grouped.select(*[F.col(k).alias(p) for k, p in zip(key, parent)], F.col("conv_id").alias("above"))
    nodes = (grouped.join(children, key, "left").join(below, key, "left").join(digests, key, "left").join(parents, parent, "left")
             .select("conv_id", "depth", F.when(F.col("depth") == 1, F.lit(everyone["low"])).otherwise(F.coalesce("above", "conv_id")).alias("parent_conv_id"),
                     "n_convs", F.coalesce("n_children", F.when(childless, 0).otherwise(1)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                     F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")))

    def alone(tail, parent_conv_id):
        own = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
        return tail.select("conv_id", "depth", parent_conv_id.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                           F.when(ends_here, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                           F.lit(0).cast("long").alias("saved_tokens"), F.when(ends_here, own).otherwise(F.lit(NO_IDS)).alias("ends_sha256"))
    deep = alone(tails.where("not parent_shared"), F.col("conv_id"))
    first = alone(tails.where("depth = 1"), F.lit(everyone["low"]))
    branch = alone(tops.join(parents, parent, "left"), F.coalesce("above", "conv_id"))
    return root.unionByName(nodes.select(*NODE)).unionByName(deep).unionByName(first).unionByName(branch)


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the trie over the conversations as they are."""
    turns = describe_turns(conversations, conv_id, turn, role, text)
    lengths = stage(turns.groupBy("conv_id").agg(F.count("*").alias("length")), "trie_lengths")
    return prefix_nodes(turns.join(lengths, "conv_id").withColumn("depth", F.col("position") + 1), lengths)


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, role, text of every node but the root: what a corpus that stores each shared prefix once consists of.
    ``turns`` comes from ``describe_turns(..., keep=("role", "text"))``, with ``depth`` where conversations were rebuilt."""
    if "depth" not in turns.columns:
        turns = turns.withColumn("depth", F.col("position") + 1)
    return nodes.where("depth > 0").select("conv_id", "depth").join(turns.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"])


GROUP, HEAD = 100, 6


def grafted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt for the query: the first h turns of the conversation whose id is the next lower multiple of 100, then
    the own turns after the first h, h being crc32 of the id modulo 6. Returns the turns and the lengths."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    planned = stage(own, "trie_own_lengths")
    bases = planned.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    lengths = stage(
        planned.withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD}).join(bases, "base", "left")
        .withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0))))
        .withColumn("length", F.col("head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).select("conv_id", "base", "h", "head", "length"), "trie_lengths")
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("position") < HEAD)).withColumnRenamed("conv_id", "base")
    columns = ["conv_id", "u", "v", "chars", "length"]
    front = lengths.join(heads, "base").where("position < h").select(*columns, (F.col("position") + 1).alias("depth"))
    rest = turns.join(lengths, "conv_id").where("position >= h").select(*columns, (F.col("head") + F.col("position") - F.col("h") + 1).alias("depth"))
    return front.unionByName(rest), lengths.select("conv_id", "length")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_nodes(*grafted(describe_turns(chats)))


ORACLE = r"""
WITH base AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i
              FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, count(*) AS own, xor(4294967295::BIGINT, list_reduce(
          list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
          lambda x, s: list_reduce([xor(x, s), 1, 1, 1, 1, 1, 1, 1, 1], lambda y, one: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))) % 6 AS h
        FROM base GROUP BY conv_id),
parts AS (SELECT c.conv_id, 0 AS part, b.i, b.role, b.text FROM crc c JOIN base b ON b.conv_id = c.conv_id - c.conv_id % 100 AND b.i < c.h
          UNION ALL SELECT c.conv_id, 1, b.i, b.role, b.text FROM crc c JOIN base b ON b.conv_id = c.conv_id AND b.i >= c.h),
turns AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
                 md5(string_agg(md5(length(role) || ':' || role || text), '') OVER w) AS node
          FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)),
rows_ AS (SELECT conv_id, depth, chars, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent,
                 depth = count(*) OVER (PARTITION BY conv_id) AS last FROM turns
          UNION ALL SELECT conv_id, 0, 0, 'root', NULL, NOT EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = c.conv_id) FROM crc c),
nodes AS (SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) AS chars,
                 sha256(coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM rows_ GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent),
below AS (SELECT a.node, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens, count(*) FILTER (k.n IS NULL) AS n_leaves
          FROM nodes n JOIN rows_ a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids k ON k.node = n.node GROUP BY a.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN below b ON b.node = n.node
"""

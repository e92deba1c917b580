"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). Of every ``window`` consecutive
words, the k-gram with the smallest hash is kept as fingerprint, on both sides by the same rule, so every window that occurs
in a document shares a fingerprint with it (the winnowing guarantee). Matching fingerprints are extended to whole windows and
confirmed word by word, which leaves no false hit.

Short items are handled by the same rule with their own window size: one family of fingerprints per window size that occurs,
of which there are at most ``window``.

A benchmark of up to ``block_words`` words is indexed in every task, and documents are not shuffled; that is the usual case. A
larger one is never gathered: its fingerprints are a table, which is joined with the fingerprints of the documents (``_joined``),
and the documents are read once for those, whatever the size of the benchmark. Both ways give the same rows.

Defined results: a null or empty text, or an item without words, has no windows and no hits. Repeated items are all named.
Document rows are answered one by one, whatever their ids, with a small and a large benchmark.
Empty tables give empty results or no hits. Other columns of the documents pass through.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from dossierlens.llm.arrays import LOWER, Words, byte_classes, flat, pieces, sliding_min
from dossierlens.storage import stage

WORD = byte_classes((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
WINDOW, GRAM = 13, 6
BLOCK_WORDS = 1_000_000
SIEVE_BITS = 1 << 27
# Lists that the candidate items of one document are spread over.
PARTS = 16
HIT_COLUMNS = StructType([
    StructField("n_words", LongType()), StructField("hit_from", ArrayType(IntegerType())),
    StructField("hit_to", ArrayType(IntegerType())), StructField("item_ids", ArrayType(StringType()))])


def fingerprints(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept k-grams: the leftmost smallest of each run of ``window`` words."""
    size = min(gram, window)
    hashes = words.grams(size)
    hashes[~words.whole(size)] = np.iinfo(np.uint64).max
    width = window - size + 1
    lowest = sliding_min(hashes, width)
    full = words.whole(window)
    keep = np.zeros(len(hashes), bool)
    for k in range(width):
        end = len(hashes) - k
        keep[k:] |= full[:end] & (hashes[k:] == lowest[:end])
    at = np.flatnonzero(keep)
    return at, hashes[at]


class Index:
    """Fingerprints and windows of one block of benchmark items."""

    def __init__(self, items: list, window: int, gram: int):
        texts = pa.array([text for _, text in items], pa.string())
        data, starts = flat(texts)
        words = Words(data, starts, WORD)
        low = LOWER[data].tobytes()
        spelled = [low[s:e] for s, e in zip(words.start, words.end)]
        self.gram, self.windows, sizes = gram, {}, {}
        for k, (item, _) in enumerate(items):
            first, last = int(words.first[k]), int(words.first[k + 1])
            size = min(window, last - first)
            if size:
                sizes.setdefault(size, []).append(k)
                for at in range(first, last - size + 1):
                    self.windows.setdefault(b" ".join(spelled[at: at + size]), {})[str(item)] = None
        self.known = {}
        for size, own in sizes.items():
            part, begins = flat(texts.take(pa.array(own)))
            _, hashes = fingerprints(Words(part, begins, WORD), size, gram)
            self.known[size] = np.unique(hashes)

    def hits(self, data: np.ndarray, starts: np.ndarray) -> dict:
        """Text index -> (sorted non-overlapping word ranges, item ids) for the texts with hits; word counts of all texts."""
        words = Words(data, starts, WORD)
        found = {}
        for size, known in self.known.items():
            at, hashes = fingerprints(words, size, self.gram)
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for position in at[known[place] == hashes]:
                found.setdefault(int(words.of[position]), {}).setdefault(size, []).append(int(position))
        out = {}
        for text, by_size in found.items():
            first, last = int(words.first[text]), int(words.first[text + 1])
            begin = int(words.start[first])
            low = LOWER[data[begin: int(words.end[last - 1])]].tobytes()
            spelled = [low[s - begin: e - begin] for s, e in zip(words.start[first:last], words.end[first:last])]
            hit, items = np.zeros(last - first + 1, np.int64), {}
            for size, positions in by_size.items():
                slack, tried = size - min(self.gram, size), -1
                for position in positions:
                    p = position - first
                    for start in range(max(p - slack, tried + 1, 0), min(p, last - first - size) + 1):
                        named = self.windows.get(b" ".join(spelled[start: start + size]))
                        if named:
                            hit[start] += 1
                            hit[start + size] -= 1
                            items.update(named)
                    tried = max(tried, p)
            if items:
                covered = np.concatenate([[0], np.cumsum(hit[:-1]) > 0, [0]]).astype(np.int8)
                edge = np.diff(covered)
                out[text] = (np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), sorted(items))
        return out, np.diff(words.first)


def _items(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Items with words: item (text), text, words, size (words of their windows)."""
    def measured(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                n = np.diff(Words(*flat(piece.column("text")), WORD).first)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(n, pa.int64()), pa.array(np.minimum(n, window), pa.int32())],
                    names=["item", "text", "words", "size"]).filter(pa.array(n > 0))
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(measured, "item string, text string, words long, size int")


def _searched(rows: DataFrame, text: str, block: list, window: int, gram: int) -> DataFrame:
    """All rows and columns with the hits of a block of items, which every task indexes."""
    schema = StructType([*rows.schema.fields, *HIT_COLUMNS.fields])
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def searched(batches):
        index = Index(shared.value, window, gram)
        for batch in batches:
            for piece in pieces(batch, text):
                data, starts = flat(piece.column(text))
                found, counts = index.hits(data, starts)
                hits = [found.get(k, ((), (), ())) for k in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(counts, pa.int64()), pa.array([r[0] for r in hits], pa.list_(pa.int32())),
                     pa.array([r[1] for r in hits], pa.list_(pa.int32())),
                     pa.array([r[2] for r in hits], pa.list_(pa.string()))], names=schema.names)
    return rows.mapInArrow(searched, schema)


def _joined(rows: DataFrame, key: str, text: str, items: DataFrame, sizes: list, window: int, gram: int) -> DataFrame:
    """Hits of a benchmark of any size: key, hit_from, hit_to, item_ids, in several rows a document.

    Fingerprints of documents that are in no item are left out by a bit table of fixed size; the rest is joined with those of the
    items. Each pair that shares one is confirmed on the texts: a document's candidate items come to it in ``PARTS`` lists.
    """
    items = stage(items.withColumn("number", F.monotonically_increasing_id()), "benchmark_items")

    def marks(column, sizes_of):
        """(column, size, hash) of the fingerprints of each text, once per text, that the bit table holds (if given)."""
        def marked(batches):
            bits = known.value if known else None
            for batch in batches:
                for piece in pieces(batch, "text"):
                    data, starts = flat(piece.column("text"))
                    own = piece.column(0).to_numpy()
                    wanted = np.asarray(piece.column("size")) if sizes_of is None else None
                    words = Words(data, starts, WORD)
                    for size in sizes if sizes_of is None else sizes_of:
                        at, hashes = fingerprints(words, size, gram)
                        of = words.of[at]
                        if wanted is not None:
                            fits = wanted[of] == size
                            of, hashes = of[fits], hashes[fits]
                        if bits is not None:
                            cell = (hashes % np.uint64(SIEVE_BITS)).astype(np.int64)
                            fits = (bits[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1
                            of, hashes = of[fits], hashes[fits]
                        pair = np.unique(np.stack([of.astype(np.uint64), hashes]), axis=1) if len(of) else np.zeros((2, 0), np.uint64)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(own[pair[0].astype(np.int64)]), pa.array(np.full(pair.shape[1], size, np.int32)),
                            pa.array(pair[1].view(np.int64))], names=[column, "size", "hash"])
        return marked

    known = None
    of_items = stage(items.select("number", "text", "size").mapInArrow(marks("number", None), "number long, size int, hash long"), "benchmark_marks")
    cell = F.pmod(F.col("hash"), F.lit(SIEVE_BITS))  # a power of two, so that signed and unsigned hashes agree
    words = (of_items.select(cell.alias("cell")).groupBy(F.expr("cell div 64").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("bits")).toArrow())
    table = np.zeros(SIEVE_BITS // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    known = rows.sparkSession.sparkContext.broadcast(table.view(np.uint64))
    of_rows = rows.select(F.col(key).alias("row_"), F.col(text).alias("text")).mapInArrow(marks("row_", sizes), "row_ long, size int, hash long")
    pairs = of_rows.join(of_items, ["size", "hash"]).select("row_", "number").distinct()
    lists = (pairs.join(items.select("number", "item", F.col("text").alias("item_text")), "number")
             .groupBy("row_", F.pmod("number", F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("item", "item_text")).alias("items")))
    found = lists.join(rows.select(F.col(key).alias("row_"), F.col(text).alias("text")), "row_").select("row_", "text", "items")

    def confirmed(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                out = []
                for k, listed in enumerate(piece.column("items").to_pylist()):
                    hits, _ = Index([(i["item"], i["item_text"]) for i in listed], window, gram).hits(*flat(piece.column("text").slice(k, 1)))
                    out.append(hits.get(0, ((), (), ())))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row_"), pa.array([r[0] for r in out], pa.list_(pa.int32())), pa.array([r[1] for r in out], pa.list_(pa.int32())),
                     pa.array([r[2] for r in out], pa.list_(pa.string()))], names=["row_", "hit_from", "hit_to", "item_ids"])
    return found.mapInArrow(confirmed, "row_ long, hit_from array<int>, hit_to array<int>, item_ids array<string>").where(F.size("item_ids") > 0)


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` plus n_words, hit_from/hit_to (word ranges inside any occurrence), and item_ids."""
    kept = docs.drop(*HIT_COLUMNS.names)
    items = _items(benchmark, item_id, item_text, window)
    measured = items.agg(F.sum("words").alias("words"), F.collect_set("size").alias("sizes")).first()  # at most ``window`` sizes
    if (measured["words"] or 0) <= block_words:
        return _searched(kept, text, [(r.item, r.text) for r in items.sort("item", "text").collect()], window, gram)
    # Ids may be null or repeated, so each row gets a key, which is written so that every reader meets the same one.
    key = "__row"
    while key in kept.columns:
        key += "_"
    rows = stage(kept.withColumn(key, F.monotonically_increasing_id()), "keyed_documents")
    merged = _joined(rows, key, text, items, sorted(measured["sizes"]), window, gram).groupBy("row_").agg(
        F.flatten(F.collect_list(F.arrays_zip("hit_from", "hit_to"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("items"))
    # Ranges that overlap or touch become one; spans are visited in order of their start.
    fold = F.aggregate(
        F.array_sort("spans"), F.array().cast("array<struct<hit_from:int,hit_to:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["hit_to"] >= s["hit_from"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["hit_from"].alias("hit_from"),
                F.greatest(F.element_at(done, -1)["hit_to"], s["hit_to"]).alias("hit_to")))))
        .otherwise(F.concat(done, F.array(F.struct(s["hit_from"].alias("hit_from"), s["hit_to"].alias("hit_to"))))))
    merged = merged.select("row_", F.struct(fold.alias("spans"), "items").alias("found_"))
    none = F.array().cast("array<int>")
    # Without items the words are only counted.
    counted = _searched(rows, text, [], window, gram).select(key, F.struct(*kept.columns).alias("own_"), "n_words")
    return counted.join(merged, F.col(key) == F.col("row_"), "left").select(
        "own_.*", "n_words", F.coalesce(F.col("found_.spans")["hit_from"], none).alias("hit_from"),
        F.coalesce(F.col("found_.spans")["hit_to"], none).alias("hit_to"), F.coalesce("found_.items", F.array().cast("array<string>")).alias("item_ids"))


def n_hit():
    """Words inside any occurrence of a window."""
    return F.aggregate(F.zip_with("hit_to", "hit_from", lambda a, b: (a - b).cast("long")), F.lit(0).cast("long"),
                       lambda x, y: x + y)


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated: some word is hit and at least a twentieth of the words are."""
    return (found.withColumn("n_hit", n_hit()).withColumn("n_items", F.size("item_ids").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judged(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")

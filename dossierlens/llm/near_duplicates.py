"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets and star-shaped edges.

1. Every text becomes the set of its distinct word shingles (64-bit hashes). One hash per shingle picks a bin and a value;
   the smallest value per bin is the signature, and an empty bin copies the bin that a universal hash of (bin, attempt)
   leads to first. Texts with the same set are one class; only class representatives go on.
2. ``bands`` bands of ``rows`` bins are bucket keys. With the defaults a pair at similarity 0.8 shares no bucket with
   probability 3e-6, at 0.9 below 1e-12.
3. A bucket proposes a star: its smallest member with each other member, so pairs grow with the members, not their square.
   Pairs whose set sizes rule out the similarity go, the others are confirmed on full sets, and links become components.
4. A star does not compare two members that both differ from the centre. The members of buckets that still hold several
   components are therefore joined on their prefixes: of two sets at the wanted similarity, each has one of its rarest
   shingles in the other. Shingles of one component, or of one set, give no pairs. Each set carries a parity sketch; the
   bits in which two sketches differ are at most the shingles in which the sets differ, so the join itself refutes pairs
   beyond the allowed difference, without error. A shingle with many members is a grid of blocks, each pair of blocks a join key
   of its own, so that a task holds a bounded number of members. What is left is confirmed on full sets. Nothing is capped: afterwards every
   pair of a bucket is confirmed, refuted or already connected.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing. Fewer words than a
shingle are one shingle. Repeated rows and equal texts share a component. A null id is no vertex: component null, kept.
Ids are whole numbers; different texts under one id are told apart as rows (each keeps its own set size and component), but
only one of them is compared beyond equal sets. Empty table: no rows. Other columns are not part of the result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dossierlens.llm.arrays import Words, byte_classes, flat, mix, pieces
from dossierlens.llm.components import connected_components
from dossierlens.storage import stage

WORD = ~byte_classes((0x20, 0x20), (0x09, 0x0D))
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 80, 32, 5
SKETCH_WORDS = 8
# Members of a shared shingle are dealt into blocks of about this many, and blocks are compared with blocks.
GRID_ROWS = 500
# Cells of the table that orders shingles by rarity; any order is right, a rarer prefix only makes fewer pairs.
RARITY_CELLS = 1 << 18


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int) -> list:
    """Sorted distinct shingle hashes of each text."""
    words = Words(data, starts, WORD)
    grams, out = words.grams(size), []
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if last - first >= size:
            out.append(np.unique(grams[first: last - size + 1]))
        elif last > first:
            value = np.uint64(last - first)
            for h in words.hash[first:last]:
                value = mix(np.array([value], np.uint64) * np.uint64(3) ^ h)[0]
            out.append(np.array([value], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list, bins: int) -> np.ndarray:
    """One row of ``bins`` minima per non-empty set."""
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    hashes = mix(np.concatenate(sets) + np.uint64(0x51ED270B)) if len(sets) else np.zeros(0, np.uint64)
    bin_ = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    place = np.repeat(np.arange(len(sets)), sizes) * bins + bin_
    order = np.argsort(place, kind="stable")
    place, values = place[order], mix(hashes[order])
    heads = np.flatnonzero(np.diff(place, prepend=-1))
    out.ravel()[place[heads]] = np.minimum.reduceat(values, heads) if len(heads) else values
    filled = np.zeros(out.shape, bool)
    filled.ravel()[place[heads]] = True
    row, empty = np.nonzero(~filled)
    attempt = 0
    while len(row):
        attempt += 1
        donor = (mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        ok = filled[row, donor]
        out[row[ok], empty[ok]] = out[row[ok], donor[ok]]
        row, empty = row[~ok], empty[~ok]
    return out


def _described(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """id, n (set size), k1, k2 (set fingerprint), bands (bucket keys) of every row."""
    def computed(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, starts = flat(piece.column("text"))
                sets = shingle_sets(data, starts, size)
                n = np.array([len(s) for s in sets], np.int64)
                used = np.flatnonzero(n)
                keys = np.zeros((len(sets), 2), np.int64)
                for k in used:
                    keys[k] = (mix(sets[k]).sum(dtype=np.uint64).view(np.int64),
                               mix(sets[k] ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))
                values = np.zeros((len(sets), bands), np.uint64)
                if len(used):
                    sign = signatures([sets[k] for k in used], bands * rows).reshape(len(used), bands, rows)
                    key = np.tile(np.arange(bands, dtype=np.uint64), (len(used), 1))
                    for r in range(rows):
                        key = mix(key * np.uint64(0xC6A4A7935BD1E995) + sign[:, :, r])
                    values[used] = key
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, values.size + 1, bands), pa.int32()), pa.array(values.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists],
                    names=["id", "n", "k1", "k2", "bands"])
    return docs.mapInArrow(computed, "id long, n long, k1 long, k2 long, bands array<long>")


def _rarity(texts: DataFrame, size: int) -> np.ndarray:
    """How many shingles fall into each cell; the table has a fixed size."""
    def counted(batches):
        table = np.zeros(RARITY_CELLS, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = shingle_sets(*flat(piece.column("text")), size)
                table += np.bincount((np.concatenate(sets) % np.uint64(RARITY_CELLS)).astype(np.int64), minlength=RARITY_CELLS)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used])], names=["cell", "n"])
    found = texts.select("text").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(RARITY_CELLS, np.int64)
    table[found["cell"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    return table


def _prefixes(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """id, c, n, the parity sketch (bit i: whether an odd number of shingles hash to i) and the rarest shingles of each text."""
    bits = 64 * SKETCH_WORDS
    shared = texts.sparkSession.sparkContext.broadcast(_rarity(texts, size))

    def computed(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = shingle_sets(*flat(piece.column("text")), size)
                n = np.array([len(s) for s in sets])
                of = np.repeat(np.arange(len(sets)), n)
                at = (mix(np.concatenate(sets) ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)).astype(np.int64)
                odd = (np.bincount(of * bits + at, minlength=len(sets) * bits) & 1).astype(np.uint8)
                words = np.packbits(odd).view(np.int64)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, SKETCH_WORDS), pa.int32()), pa.array(words))
                rare = []
                for s in sets:
                    order = np.lexsort((s, shared.value[(s % np.uint64(RARITY_CELLS)).astype(np.int64)]))
                    rare.append(s[order[: len(s) - (percent * len(s) + 99) // 100 + 1]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("c"), pa.array(n, pa.int64()), sketch, pa.array(rare, pa.list_(pa.int64()))],
                    names=["id", "c", "n", "sketch", "rare"])
    return texts.select("id", "c", "text").mapInArrow(
        computed, "id long, c long, n long, sketch array<long>, rare array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. The rows arrive ordered by ``a``, whose set is kept meanwhile."""
    def checked(batches):
        last, own = None, None
        for batch in batches:
            for piece in pieces(batch, "text_b"):
                sets = shingle_sets(*flat(piece.column("text_b")), size)
                ids, good = piece.column("a").to_pylist(), []
                for k, (a, other) in enumerate(zip(ids, sets)):
                    if a != last:
                        last, own = a, shingle_sets(*flat(piece.column("text_a").slice(k, 1)), size)[0]
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    good.append(100 * both >= percent * (len(own) + len(other) - both))
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b")], names=["a", "b"]).filter(pa.array(good))

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(checked, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    percent: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, component_id (smallest id of the group) of every row; ``percent`` is the least Jaccard similarity."""
    rows_ = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    described = stage(_described(rows_, shingle, bands, rows), "signatures")
    key = ["n", "k1", "k2"]
    classes = stage(described.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep")), "classes")
    representatives = (described.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
                       .dropDuplicates(["id"]).select("id", "n", F.explode("bands").alias("key")))
    crowded = representatives.groupBy("key").agg(F.min(F.struct("id", "n")).alias("center"), F.count("*").alias("rows")).where("rows > 1")
    buckets = stage(representatives.join(crowded.select("key", "center"), "key"), "buckets")
    members = buckets.select("id").distinct()
    texts = stage(rows_.join(members, "id", "left_semi").dropDuplicates(["id"]), "bucket_texts")

    def alike(n, m):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    star = (buckets.where("id <> center.id").where(alike(F.col("n"), F.col("center.n")))
            .select(F.col("center.id").alias("a"), F.col("id").alias("b")).distinct())
    links = stage(_confirmed(star, texts, shingle, percent), "links")
    components = stage(connected_components(links), "components")
    placed = (buckets.select("key", "id").join(components, "id", "left")
              .select("key", "id", F.coalesce("component", "id").alias("c")))
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    open_ids = stage(placed.join(mixed, "key", "left_semi").select("id", "c").distinct(), "open_members")
    described_open = stage(_prefixes(texts.join(open_ids, "id"), shingle, percent), "prefixes")
    prefix = described_open.select(F.explode("rare").alias("key"), "id", "c")
    shared = (prefix.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.ceil(F.count("*") / GRID_ROWS).cast("int").alias("blocks"))
              .where("low < high").select("key", "blocks"))
    mixed = stage(prefix.join(shared, "key").join(described_open.select("id", "n", "sketch"), "id")
                  .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "shared_prefixes")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    differing = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("other")[k])) for k in range(SKETCH_WORDS)), F.lit(0))
    pairs = (mixed.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), "sketch", F.col("block").alias("i"), every.alias("j"))
             .join(mixed.select("key", F.col("id").alias("b"), "n", "c", F.col("sketch").alias("other"), every.alias("i"), F.col("block").alias("j")),
                   ["key", "i", "j"])
             .where((F.col("ca") < F.col("c")) & alike(F.col("na"), F.col("n"))
                    & ((100 + percent) * differing <= (100 - percent) * (F.col("na") + F.col("n"))))
             .select("a", "b").distinct())
    found = stage(_confirmed(pairs, texts, shingle, percent), "links")
    if found.limit(1).count():
        components = stage(connected_components(links.union(found)), "components")
    of_class = classes.join(components.withColumnRenamed("id", "rep"), "rep", "left").select(
        *key, F.coalesce("component", "rep").alias("component"))
    return (described.select("id", *key).join(of_class, key, "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, shingle=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

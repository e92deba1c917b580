"""Exact removal of repeated byte strings: shards of suffixes, each sorted by external induced sorting.

Every string of ``length`` bytes is owned by one of its grams: the one with the smallest hash. Equal strings have the same
owner gram at the same place, so strings of different owners never need to be compared.

1. Owner grams are counted; those that occur once own no repeated string. Runs of strings with one owner are one segment.
   Equal segments are one class with a count: where it is two or more, all strings of the segment repeat.
2. Classes that share their owner with another class, one of them occurring once, go, once each, to the partition of the owner.
   There they come in the order of their owners and are cut into shards of whole owners; ``induced_sort`` sorts the suffixes of
   a shard with their common prefixes, in files once the shard exceeds the memory limit. A string repeats if its suffix has a
   common prefix of ``length`` or more with a neighbour. Owners with more than a shard of classes are split by the place of
   the owner in the string, and beyond that by the string, which keeps equal strings together.
3. The repeated strings of a segment hold at all its places; covered bytes are cut out per text.

Fixed-size bit tables (``SIEVE_BITS``) built from owners and from documents keep most rows that cannot match out of the
shuffles. A full table lets more rows through and changes no result.

Texts are bytes, matches never cross texts, strings are judged on the input. Defined results: a null text is empty. A text
shorter than ``length`` has no strings. Rows are texts of their own, so a repeated row of ``length`` bytes or more is all
repeated. Empty table: no rows. Other columns pass through; columns named like the outputs are replaced.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from dossierlens.llm.arrays import flat, mix, pieces, powers, sliding_min
from dossierlens.llm.induced_sort import CAP, suffix_array
from dossierlens.storage import stage

LENGTH, GRAM = 200, 64
# A shard holds owners up to this size and at most one more; the sort takes about a hundred times its bytes.
SHARD_BYTES = 1_000_000
PARTITION_BYTES = 64_000_000
# Texts are taken in slices of this size: the hashes of a slice take about a hundred times its bytes.
SLICE_BYTES = 500_000
MEMORY = 1 << 21
SIEVE_BITS = 1 << 26
OWNED = "h long, s long, key long, key2 long, n int, los array<long>"
KEY = ["key", "key2"]


def owners(data: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """Runs of strings with one owner: text, hash of the owner, first and number of strings, place of the owner; all in bytes
    from the begin of the text."""
    forward, backward = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[:-1], out=sums[1:])
    grams = max(0, len(data) - gram + 1)
    strings = max(0, len(data) - length + 1)
    hashes = mix((sums[gram:] - sums[:grams]) * backward[:grams])
    # The high half decides, the low half holds the place, so of equal hashes the leftmost owns the string.
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    place = (sliding_min(key, length - gram + 1)[:strings] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:strings]
    inside = np.flatnonzero(np.arange(strings) + length <= starts[1:][text])
    place, text = place[inside], text[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    begin = starts[:-1][text[head]]
    return (text[head], hashes[place[head]].view(np.int64), inside[head] - begin, np.diff(np.append(head, len(inside))),
            place[head] - begin)


def sieve(values: DataFrame) -> np.ndarray:
    """Bit table of a column ``v`` of 64-bit hashes; at most SIEVE_BITS / 64 rows come to the driver."""
    at = F.col("v").bitwiseAND(F.lit(SIEVE_BITS - 1))
    words = (values.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(v & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b"))).toArrow()
    table = np.zeros(SIEVE_BITS // 64, np.uint64)
    table[np.asarray(words.column("w"))] = np.asarray(words.column("b")).view(np.uint64)
    return table


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    values = values.view(np.uint64)
    return (table[((values & np.uint64(SIEVE_BITS - 1)) >> np.uint64(6)).astype(np.int64)] >> (values & np.uint64(63))) & np.uint64(1) == 1


def _repeated(segments: list, length: int) -> list:
    """For each segment (bytes) the runs of its strings that occur at another place of the shard, as (first, end) lists."""
    sizes = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(sizes + 1)
    joined = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8)
    text = joined.astype(np.int32)
    text += 2
    text[ends - 1], text[-1] = 1, 0
    order, prefix = suffix_array(text, 258, MEMORY, length)
    near = prefix >= length
    near[:-1] |= near[1:]
    hit = np.zeros(len(text) + 1, bool)
    hit[order[near]] = True
    # A suffix that begins too near the end of its segment holds no whole string.
    begins = ends - 1 - sizes
    out = []
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        own = np.zeros(size - length + 3, np.int8)
        own[1:-1] = hit[begin: begin + size - length + 1]
        edge = np.diff(own)
        out.append((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
    return out


def _shards(batches, shard_bytes: int):
    """Tables of rows ordered by (h, part): whole groups, until they reach ``shard_bytes``."""
    held, size, last = [], 0, None
    for batch in batches:
        h, part = np.asarray(batch.column("h")), np.asarray(batch.column("part"))
        heads = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]))) if len(h) else []
        for first, end in zip(heads, [*heads[1:], len(h)]):
            if size >= shard_bytes and last != (h[first], part[first]):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(first, end - first))
            size += pc.sum(pc.binary_length(held[-1].column("bytes"))).as_py()
            last = (h[first], part[first])
    if held:
        yield pa.Table.from_batches(held)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All rows and columns plus ``spans`` (array of start, end: maximal runs of removed bytes) and ``kept`` (the other bytes)."""
    if not gram < length < CAP:
        raise ValueError(f"the length must lie between the gram size and {CAP}")
    spark = docs.sparkSession
    # Rows are told apart by 128 bits of their values; equal rows are equal texts, so it does not matter which is met. Maps, at any
    # depth, cannot be hashed and are left out.
    own = [F.col(c) for c, t in docs.dtypes if "map<" not in t]
    identity = [F.xxhash64(*own), F.xxhash64(F.lit("second"), *own)]
    rows = docs.select(*[c.alias(name) for c, name in zip(identity, KEY)], F.col(text).alias("text"))

    def counted(batches):
        for batch in batches:
            for piece in pieces(batch, "text", SLICE_BYTES):
                _, h, _, _, _ = owners(*flat(piece.column("text")), length, gram)
                value, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["h", "n"])
    repeated = stage(rows.select("text").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
                     .where("n > 1").select("h"), "repeated_owners")
    known = spark.sparkContext.broadcast(sieve(repeated.select(F.col("h").alias("v"))))

    def owned(batches):
        for batch in batches:
            for piece in pieces(batch, "text", SLICE_BYTES):
                data, starts = flat(piece.column("text"))
                raw, keys, keys2 = data.tobytes(), np.asarray(piece.column("key")), np.asarray(piece.column("key2"))
                of, h, lo, n, _ = owners(data, starts, length, gram)
                use = np.flatnonzero(passes(known.value, h))
                of, h, lo, n = of[use], h[use], lo[use], n[use]
                first = starts[of] + lo
                s = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + length - 1).tolist())], np.uint64)
                # Segments that one text repeats are one row with several places.
                order = np.lexsort((lo, s, h, of))
                of, h, s, lo, n = of[order], h[order], s[order].view(np.int64), lo[order], n[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1])
                head = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(head, len(of)), pa.int32()), pa.array(lo))
                yield pa.RecordBatch.from_arrays([pa.array(h[head]), pa.array(s[head]), pa.array(keys[of[head]]),
                                                  pa.array(keys2[of[head]]), pa.array(n[head], pa.int32()), places],
                                                 names=["h", "s", *KEY, "n", "los"])
    segments = stage(rows.mapInArrow(owned, OWNED).join(repeated, "h", "left_semi"), "segments")
    classes = (segments.groupBy("h", "s").agg(F.sum(F.size("los")).alias("times"), F.first("key").alias("key"), F.first("key2").alias("key2"),
                                              F.first(F.col("los")[0]).alias("lo"), F.first("n").alias("n")))
    classes = stage(classes, "classes")
    # Owners of which every segment occurs twice or more are settled.
    crowds = (classes.groupBy("h").agg(F.count("*").alias("of_owner"), F.min("times").alias("fewest"), F.sum(F.col("n") + length).alias("bytes"))
              .where("of_owner > 1 and fewest = 1").drop("fewest"))
    compared = stage(classes.join(crowds, "h"), "compared")
    total = compared.agg(F.sum(F.col("n") + length)).first()[0] or 0
    at_once = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    partitions = max(1, at_once, -(-total // PARTITION_BYTES))
    wanted = spark.sparkContext.broadcast(sieve(compared.select(F.col("key").alias("v"))))

    def chosen(table, keep, key="key"):
        def filtered(batches):
            for batch in batches:
                yield batch.filter(pa.array(passes(table.value, np.asarray(batch.column(key))) == keep))
        return filtered
    of_text = compared.groupBy(*KEY).agg(F.collect_list(F.struct("h", "s", "lo", "n", "bytes")).alias("cuts"))
    sources = (rows.mapInArrow(chosen(wanted, True), "key long, key2 long, text string").join(of_text, KEY)
               .dropDuplicates(KEY).select("text", "cuts"))

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                out = []
                for body, cuts in zip(piece.column("text").cast(pa.binary()), piece.column("cuts").to_pylist()):
                    body = body.as_py()
                    for c in cuts:
                        # Parts and salts follow from the bytes of the owner, so that all its segments are cut alike.
                        parts = min(length - gram + 1, -(-c["bytes"] // shard_bytes))
                        more = -(-c["bytes"] // (shard_bytes * (length - gram + 1)))
                        # The place of a string is counted from its owner, as equal strings of other segments count it.
                        shift = (c["lo"] - _owner_place(body, c["lo"], length, gram)) if parts > 1 else 0
                        size = -(-(length - gram + 1) // parts) if parts > 1 else c["n"]
                        first = 0
                        while first < c["n"]:
                            last = c["n"] if parts == 1 else min(c["n"], ((shift + first) // size + 1) * size - shift)
                            bytes_ = body[c["lo"] + first: c["lo"] + last + length - 1]
                            salt = xxhash.xxh3_64_intdigest(bytes_) % more if size == 1 and parts > 1 else 0
                            out.append((c["h"], c["s"], first, ((shift + first) // size if parts > 1 else 0) * 1_000_003 + salt, bytes_))
                            first = last
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), CUT_TYPES)] if out else
                                                 [pa.array([], t) for t in CUT_TYPES], names=["h", "s", "first", "part", "bytes"])
    CUT_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    strings = sources.mapInArrow(cut, "h long, s long, first int, part long, bytes binary").repartition(partitions, "h", "part").sortWithinPartitions("h", "part")

    def sorted_(batches):
        for shard in _shards(batches, shard_bytes):
            found = _repeated(shard.column("bytes").to_pylist(), length)
            at = shard.column("first").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [shard.column("h").combine_chunks(), shard.column("s").combine_chunks(),
                 pa.array([a + f for (a, _), f in zip(found, at)], pa.list_(pa.int64())),
                 pa.array([b + f for (_, b), f in zip(found, at)], pa.list_(pa.int64()))], names=["h", "s", "begins", "ends"])
    sorted_out = strings.mapInArrow(sorted_, "h long, s long, begins array<long>, ends array<long>").where("size(begins) > 0")
    several = classes.where("times > 1").select("h", "s", F.array(F.lit(0).cast("long")).alias("begins"), F.array(F.col("n").cast("long")).alias("ends"))
    runs = stage(sorted_out.unionByName(several), "repeated_runs")
    covered = stage(segments.select("h", "s", *KEY, "los").join(runs, ["h", "s"]).groupBy(*KEY).agg(
        F.collect_list(F.struct("los", "begins", "ends")).alias("runs")), "covered")
    touched = spark.sparkContext.broadcast(sieve(covered.select(F.col("key").alias("v"))))
    kept = [c for c in docs.columns if c not in ("spans", "kept")]
    span = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    schema = StructType([*docs.select(kept).schema.fields, StructField("spans", span), StructField("kept", BinaryType())])
    # The text travels once, unless its own column is replaced by an output.
    names = []
    for name in ("__text", "__key", "__key2", "__runs"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    body_, *places, runs_ = names
    body_ = text if text in kept else body_
    whole = docs.select(*kept, *([] if text in kept else [F.col(text).alias(body_)]), *[c.alias(name) for c, name in zip(identity, places)])

    def removed(batches):
        for batch in batches:
            for piece in pieces(batch, body_):
                columns = [piece.column(c) for c in range(len(kept))]
                bodies, starts = flat(piece.column(body_))
                runs = piece.column(runs_).to_pylist() if runs_ in piece.schema.names else [None] * piece.num_rows
                spans, rest = [], []
                for k, own in enumerate(runs):
                    body = bodies[starts[k]: starts[k + 1]]
                    if not own:
                        spans.append([])
                        rest.append(body.tobytes())
                        continue
                    up, down = [], []
                    for run in own:
                        for lo in run["los"]:
                            up += [lo + at for at in run["begins"]]
                            down += [lo + at + length - 1 for at in run["ends"]]
                    depth = np.bincount(up, minlength=len(body) + 1) - np.bincount(down, minlength=len(body) + 1)
                    gone = np.cumsum(depth)[:-1] > 0
                    edge = np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))
                    spans.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
                    rest.append(body[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                                  pa.array(rest, pa.binary())], names=schema.names)
    untouched = chosen(touched, False, places[0])
    runs_of = covered.select(*[F.col(c).alias(name) for c, name in zip(KEY, places)], F.col("runs").alias(runs_))
    met = whole.mapInArrow(chosen(touched, True, places[0]), whole.schema).join(runs_of, places, "left").drop(*places)
    # Other texts are filtered and passed on by one Python worker.
    return met.mapInArrow(removed, schema).unionByName(whole.mapInArrow(lambda batches: removed(untouched(batches)), schema))


def _owner_place(body: bytes, lo: int, length: int, gram: int) -> int:
    """Place of the owner of the string that begins at ``lo``."""
    data = np.frombuffer(body[lo: lo + length], np.uint8)
    return lo + int(owners(data, np.array([0, len(data)]), length, gram)[4][0])


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = repeated_spans(docs)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), n_removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""Approximate nearest neighbours by largest inner product: p-stable hashing with multiprobe search.

* Equal vectors are one class with its smallest ids, so a vector that a third of all rows share is searched and found once.
* One more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, turns the largest inner product into the smallest distance.
  Each of ``tables`` tables hashes with ``hashes`` functions floor((a.x + b) / w), a normal (2-stable).
* A query visits its own bucket and buckets at offsets -1, 0, 1 per hash, in ascending order of the summed squared distance to
  the crossed borders, which is the estimated order of success.
* Fit: the width w and the number of probes come from ``SAMPLE`` query vectors (a fixed, documented bound) whose true
  neighbours are found by an exact pass over all vectors: w follows the distance of the last neighbour, and the probes are the
  fewest with ``recall`` on the sample. All rows are indexed, and none is left out of a bucket.
* Candidates of a bucket are scored as one matrix product in double precision. Buckets beyond ``GROUP_ROWS`` vectors are split,
  with the probing queries copied to each part; queries beyond ``GROUP_ROWS`` are split too, with the vectors of the index
  copied to each part. A task holds about ``GROUP_ROWS`` vectors of either side at a time.
* Queries that find fewer candidates than wanted (small tables) get the exact pass, in blocks of ``BLOCK`` queries.

Vectors that are null, zero, hold null or non-finite components, or have another length than most vectors take no part. A
repeated row counts once. Ties go to the smaller id. Empty table: no rows. Other columns are not part of the result.
"""

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dossierlens.storage import stage

TABLES, HASHES, SAMPLE, BLOCK, GROUP_ROWS = 6, 5, 64, 1024, 20_000
FOUND = "query long, candidate long, score double"


@dataclass
class Hashing:
    directions: np.ndarray  # tables x hashes x (dimensions + 1)
    offsets: np.ndarray
    width: float
    largest: float
    probes: int = 1

    def _places(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """tables x rows x hashes"""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.largest ** 2 - (vectors ** 2).sum(axis=1), 0))
        full = np.column_stack([vectors, rest])
        return (np.einsum("tkd,nd->tnk", self.directions, full, optimize=True) + self.offsets[:, None]) / self.width

    @staticmethod
    def _keys(cells: np.ndarray) -> np.ndarray:
        key = np.zeros(cells.shape[:-1], np.int64)
        for k in range(cells.shape[-1]):
            key = key * 1_000_003 + cells[..., k]
        return key

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """tables x rows"""
        return self._keys(np.floor(self._places(vectors, False)).astype(np.int64))

    def probed(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """tables x rows x probes, best first"""
        places = self._places(vectors, True)
        cells = np.floor(places).astype(np.int64)
        into = places - cells
        steps = np.array(list(itertools.product((0, -1, 1), repeat=places.shape[-1])))
        cost = np.zeros((*places.shape[:2], len(steps)))
        for k in range(places.shape[-1]):
            # Indexed by the step: 0 stays, 1 goes up, and -1, the last entry, goes down.
            border = np.stack([np.zeros(into.shape[:2]), (1 - into[..., k]) ** 2, into[..., k] ** 2], axis=-1)
            cost += border[..., steps[:, k]]
        order = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
        return self._keys(cells[:, :, None, :] + steps[order])


def _matrix(blobs, kind) -> np.ndarray:
    blobs = list(blobs)
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64) if blobs else np.zeros((0, 1))


def _best(query: np.ndarray, candidate: np.ndarray, score: np.ndarray, count: int) -> np.ndarray:
    """Indices of the best ``count`` entries of every query: largest score, then smallest candidate; pairs once."""
    order = np.lexsort((candidate, -score, query))
    q, c = query[order], candidate[order]
    keep = np.ones(len(order), bool)
    keep[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
    order, q = order[keep], q[keep]
    first = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < count]


def _top(scores: np.ndarray, count: int):
    """Row and column of all entries that are at least the ``count``-th largest of their row."""
    if scores.shape[1] > count:
        least = -np.partition(-scores, count - 1, axis=1)[:, count - 1]
        return np.nonzero(scores >= least[:, None])
    return np.nonzero(np.ones(scores.shape, bool))


def _exact(classes: DataFrame, ids: np.ndarray, vectors: np.ndarray, count: int, kind) -> DataFrame:
    """The exact pass of a block of queries over all vectors: each task keeps its best per query, then they are merged."""
    shared = classes.sparkSession.sparkContext.broadcast((ids, vectors))

    def scored(batches):
        ids, vectors = shared.value
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                scores = vectors @ _matrix(part.column("vector").to_pylist(), kind).T
                row, column = _top(scores, count)
                own = np.asarray(part.column("rep"))
                kept = [np.concatenate([a, b]) for a, b in zip(kept, (ids[row], own[column], scores[row, column]))]
                best = _best(*kept, count)
                kept = [a[best] for a in kept]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in kept], names=["query", "candidate", "score"])
    return _merged(classes.select("rep", "vector").mapInArrow(scored, FOUND), count)


def _keyed(df: DataFrame) -> DataFrame:
    """A table that grows with the input, for a join by key in the tasks: a broadcast would pass all of it through the driver, and
    several that Spark measures as just small enough fill the driver's memory at once."""
    return df.hint("merge")


def _merged(found: DataFrame, count: int) -> DataFrame:
    pairs = found.groupBy("query", "candidate").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("place")


def _fitted(spark, classes: DataFrame, sample: DataFrame, count: int, kind, recall: float, tables: int, hashes: int) -> Hashing:
    """Directions, width and probes from at most ``SAMPLE`` queries and their exact neighbours."""
    rows = sample.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    queries, ids = _matrix([r.vector for r in rows], kind), np.array([r.rep for r in rows], np.int64)
    near = _exact(classes, ids, queries, count, kind).join(classes.select(F.col("rep").alias("candidate"), "vector"), "candidate")
    near = near.where("query <> candidate").collect()  # SAMPLE x count rows at most
    largest = float(np.sqrt(classes.agg(F.max("square")).first()[0]))
    place = {q: k for k, q in enumerate(ids.tolist())}
    of = np.array([place[r.query] for r in near], int)
    neighbours = _matrix([r.vector for r in near], kind)
    random = np.random.default_rng(20)
    directions = random.normal(size=(tables, hashes, queries.shape[1] + 1))
    squares = (queries[of] ** 2).sum(axis=1) + largest ** 2 - 2 * np.array([r.score for r in near]) if near else np.ones(1)
    width = 1.35 * float(np.sqrt(max(np.median(squares), 1e-12 * largest ** 2 + 1e-300)))
    hashing = Hashing(directions, random.uniform(0, width, (tables, hashes)), width, largest, 3 ** hashes)
    if near:
        home = hashing.buckets(neighbours)  # tables x pairs
        order = hashing.probed(queries, 3 ** hashes)[:, of]  # tables x pairs x probes
        hit = order == home[:, :, None]
        step = np.where(hit.any(axis=2), hit.argmax(axis=2), 3 ** hashes).min(axis=0)
        reached = np.sort(step)[min(len(step) - 1, int(np.ceil(recall * len(step))) - 1)]
        hashing.probes = int(min(reached + 1, 3 ** hashes))
    return hashing


def nearest(rows: DataFrame, queries: DataFrame, count: int = 20, vec_id: str = "vec_id", vector: str = "embedding", recall: float = 0.975,
            tables: int = TABLES, hashes: int = HASHES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the nearest of ``rows`` found, without the query's own id."""
    spark = rows.sparkSession
    kind = np.dtype("<f4") if rows.schema[vector].dataType.elementType.typeName() == "float" else np.dtype("<f8")

    def usable(df):
        x = F.col(vector)
        finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return (df.select(F.col(vec_id).cast("long").alias("id"), x.alias("x"))
                .where(F.col("id").isNotNull() & (F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0)))

    everything = usable(rows)
    common = everything.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    everything, asked = (d.where(F.size("x") == common["n"]).distinct() for d in (everything, usable(queries)))
    # The best count + 1 ids of equal vectors are all that any query can get from them.
    order = Window.partitionBy("x").orderBy("id")
    first = everything.withColumn("k", F.row_number().over(order)).where(F.col("k") <= count + 1)
    groups = first.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def packed(batches):
        for batch in batches:
            values = np.array(batch.column("x").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            blobs = [v.tobytes() for v in values.astype(kind)]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("ids"), pa.array(blobs, pa.binary()),
                                              pa.array((values ** 2).sum(axis=1))], names=["x", "ids", "vector", "square"])
    x_type = rows.schema[vector].dataType.simpleString()
    classes = stage(groups.mapInArrow(packed, f"x {x_type}, ids array<long>, vector binary, square double")
                    .select(F.col("ids")[0].alias("rep"), "x", "ids", "vector", "square"), "classes")
    asked = stage(asked.join(_keyed(classes.select("x", "rep", "vector")), "x").select("id", "rep", "vector"), "queries")
    heads = stage(asked.select("rep", "vector").distinct(), "query_classes")
    wanted = min(count + 1, classes.count())
    hashing = _fitted(spark, classes, heads, wanted, kind, recall, tables, hashes)
    shared = spark.sparkContext.broadcast(hashing)

    def indexed(batches):
        for batch in batches:
            keys = shared.value.buckets(_matrix(batch.column("vector").to_pylist(), kind))
            for table in range(len(keys)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, table, np.int32)), pa.array(keys[table]),
                                                  batch.column("rep"), batch.column("vector")], names=["tab", "bucket", "id", "vector"])

    def probing(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = shared.value.probed(_matrix(part.column("vector").to_pylist(), kind), shared.value.probes)
                for table in range(len(keys)):
                    lists = pa.array(list(keys[table]), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, table, np.int32)), lists, part.column("rep")],
                                                     names=["tab", "buckets", "id"])
    index = stage(classes.select("rep", "vector").mapInArrow(indexed, "tab int, bucket long, id long, vector binary"), "index")
    # Probes are ids and buckets; a query's vector joins them once per task group.
    probes = heads.mapInArrow(probing, "tab int, buckets array<long>, id long").select("tab", F.explode("buckets").alias("bucket"), "id")
    sizes = index.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("parts"))
    groups = max(16, index.count() // GROUP_ROWS)
    sides = max(1, -(-heads.count() // GROUP_ROWS))

    def dealt(df, part):
        """``cell`` is a part of a bucket, ``deal`` the task group that holds it."""
        return (df.join(_keyed(sizes), ["tab", "bucket"]).withColumn("part", part)
                .select(F.xxhash64("tab", "bucket", "part").alias("cell"), "id", *[c for c in df.columns if c == "vector"])
                .withColumn("deal", F.pmod(F.col("cell"), F.lit(groups)).cast("int")))
    # ``side`` is a part of the queries; each has its own copy of the deals.
    left = dealt(index, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left = left.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    right = dealt(probes, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).groupBy("deal", "id").agg(
        F.collect_set("cell").alias("cells"))
    right = right.join(_keyed(heads.select(F.col("rep").alias("id"), "vector")), "id").withColumn("side", F.pmod(F.xxhash64("id"), F.lit(sides)).cast("int"))

    def searched(index, asked):
        if not len(index) or not len(asked):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "candidate": np.zeros(0, np.int64), "score": np.zeros(0)})
        index = index.sort_values("cell", kind="stable")
        vectors, ids, cells = _matrix(index["vector"], kind), index["id"].to_numpy(), index["cell"].to_numpy()
        queries, query_ids = _matrix(asked["vector"], kind), asked["id"].to_numpy()
        of = np.repeat(np.arange(len(asked)), asked["cells"].map(len))
        wanted_cells = np.concatenate(asked["cells"].tolist()).astype(np.int64)
        order = np.argsort(wanted_cells, kind="stable")
        of, wanted_cells = of[order], wanted_cells[order]
        kept, size = [], 0
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        heads = np.flatnonzero(np.diff(wanted_cells, prepend=wanted_cells[0] - 1))
        for begin, end in zip(heads, np.append(heads[1:], len(wanted_cells))):
            first, last = np.searchsorted(cells, wanted_cells[begin], "left"), np.searchsorted(cells, wanted_cells[begin], "right")
            for at in range(begin, end, BLOCK):
                who = of[at: min(end, at + BLOCK)]
                scores = queries[who] @ vectors[first:last].T
                row, column = _top(scores, wanted)
                kept.append((query_ids[who][row], ids[first:last][column], scores[row, column]))
                size += len(row)
                if size > 2_000_000:
                    merged = [np.concatenate(a) for a in zip(best, *kept)]
                    top = _best(*merged, wanted)
                    best, kept, size = [a[top] for a in merged], [], 0
        merged = [np.concatenate(a) for a in zip(best, *kept)]
        top = _best(*merged, wanted)
        return pd.DataFrame({"query": merged[0][top], "candidate": merged[1][top], "score": merged[2][top]})

    found = stage(_merged(left.groupBy("deal", "side").cogroup(right.groupBy("deal", "side")).applyInPandas(searched, FOUND), wanted), "found")
    enough = found.groupBy("query").count().where(F.col("count") >= wanted)
    short = heads.join(_keyed(enough.select(F.col("query").alias("rep"))), "rep", "left_anti").sort("rep")
    block = []
    extra = []

    def complete():
        if block:
            extra.append(_exact(classes, np.array([r.rep for r in block], np.int64), _matrix([r.vector for r in block], kind), wanted, kind))
            block.clear()
    for r in short.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            complete()
    complete()
    for more in extra:
        found = found.unionByName(more)
    if extra:
        found = _merged(found, wanted)
    expanded = (found.join(_keyed(classes.select(F.col("rep").alias("candidate"), "ids")), "candidate")
                .select(F.col("query").alias("rep"), "score", F.explode("ids").alias("vec_id"))
                .join(_keyed(asked.select("rep", F.col("id").alias("query_id"))), "rep").where("query_id <> vec_id"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (expanded.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= count)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))

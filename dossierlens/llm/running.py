"""Positions and running totals within groups, in a global order, without gathering a group in one task.

Rows are range-partitioned by group and order, so that a group of any size spreads over as many partitions as its rows need.
Each task numbers and adds up its own rows in numpy; a group that begins in an earlier partition gets what the partitions
before it have counted. Those carries are one row per partition at most, never one per row or group.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from dossierlens.storage import stage

# Totals are kept modulo 2^62, so that two of them can be added without leaving a long.
MASK = (1 << 62) - 1


def _codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values, null being a value of its own."""
    encoded = pc.dictionary_encode(column, null_encoding="encode")
    return np.asarray(encoded.indices)


def _numbered(group: list, sums: list):
    def local(batches):
        part, row, last, count, totals, first = TaskContext.get().partitionId(), 0, None, 0, [np.uint64(0)] * len(sums), True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(batch.schema.get_field_index(g)) for g in group]
            new = np.zeros(n, bool)
            for key in keys:
                codes = _codes(key)
                new[1:] |= codes[1:] != codes[:-1]
            head = tuple(k[0].as_py() for k in keys)
            new[0] = last is not None and head != last
            if new[0]:
                count, totals, first = 0, [np.uint64(0)] * len(sums), False
            # Index of the row that begins each row's group; -1 where that lies in an earlier batch.
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            position = np.arange(n) - np.maximum(begin, 0) + np.where(begin < 0, count, 0)
            out, ends = [], []
            for s, before in zip(sums, totals):
                values = batch.column(batch.schema.get_field_index(s)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
                total = np.cumsum(values, dtype=np.uint64)
                base = np.where(begin > 0, total[np.maximum(begin, 1) - 1], np.uint64(0))
                run = (total - base + np.where(begin < 0, before, np.uint64(0))) & np.uint64(MASK)
                out.append(pa.array(run.astype(np.int64)))
                ends.append(run[-1])
            of_first = np.cumsum(new) == 0 if first else np.zeros(n, bool)
            if begin[-1] >= 0 and first and new.any():
                first = False
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(position, pa.int64()), *out, pa.array(np.full(n, part), pa.int32()),
                 pa.array(np.arange(row, row + n), pa.int64()), pa.array(of_first)],
                names=[*batch.schema.names, "position", *[f"run_{s}" for s in sums], "part_", "row_", "first_"])
            last, count, totals, row = tuple(k[n - 1].as_py() for k in keys), int(position[-1]) + 1, ends, row + n
    return local


def running(rows: DataFrame, group: list, order: list, sums: list = (), name: str = "running") -> DataFrame:
    """All columns plus ``position`` (from 0 in the group) and, for each column of ``sums``, its total ``run_<column>`` up to
    and with the row, modulo 2^62.

    ``group`` lists columns (empty: one group of all rows, null is a value), ``order`` sort expressions that should tell all
    rows apart, so that equal keys can be cut anywhere. Values of ``sums`` are longs from 0 on; null counts as 0.
    """
    sums = list(sums)
    by = [*[F.col(g).asc_nulls_first() for g in group], *order]
    schema = StructType([*rows.schema.fields, StructField("position", LongType()), *[StructField(f"run_{s}", LongType()) for s in sums],
                         StructField("part_", IntegerType()), StructField("row_", LongType()), StructField("first_", BooleanType())])
    local = stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_numbered(group, sums), schema), name)
    key = F.struct(*[F.col(g) for g in group]) if group else F.struct(F.lit(0).alias("all"))
    ends = local.groupBy("part_").agg(
        F.min_by(key, "row_").alias("head"),
        F.max_by(F.struct(key.alias("group"), "position", F.array(*[F.col(f"run_{s}") for s in sums]).cast("array<long>").alias("run")),
                 "row_").alias("tail")).collect()
    carries, last, count, totals = [], None, 0, [0] * len(sums)
    for end in sorted(ends, key=lambda e: e["part_"]):
        goes_on = last is not None and tuple(end["head"]) == last
        if goes_on:
            carries.append((end["part_"], True, count, *totals))
        same = goes_on and tuple(end["tail"]["group"]) == last
        count, totals = ((count if same else 0) + end["tail"]["position"] + 1,
                         [((before if same else 0) + run) & MASK for before, run in zip(totals, end["tail"]["run"])])
        last = tuple(end["tail"]["group"])
    kept = [*rows.columns, "position", *[f"run_{s}" for s in sums]]
    if not carries:
        return local.select(*kept)
    names = ["count_", *[f"carry_{k}" for k in range(len(sums))]]
    carried = rows.sparkSession.createDataFrame(carries, ", ".join(["part_ int", "first_ boolean", *[f"{n} long" for n in names]]))
    joined = local.join(F.broadcast(carried), ["part_", "first_"], "left")  # at most one row per sort partition
    whole = {"position": F.col("position") + F.coalesce("count_", F.lit(0))} | {
        f"run_{s}": (F.col(f"run_{s}") + F.coalesce(f"carry_{k}", F.lit(0))).bitwiseAND(F.lit(MASK)) for k, s in enumerate(sums)}
    return joined.withColumns(whole).select(*kept)

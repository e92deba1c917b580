"""Mixing sources to target weights by weighted fair queueing.

1. The documents of a source are put in a reproducible random order (md5 of the id, then of the text) and may be read up to
   ``repeats`` times. A document read in pass e has the virtual finish time (e times the source's words + its own running
   total) / target: a source with twice the target moves through its documents twice as fast.
2. Sources in code point order (null last) have the weights ``weights``, repeating. A source's target is its share of the
   budget by weight, but at most ``repeats`` times its size; what is cut off goes to the others by weight until no target is
   above. With the budget left for the open sources and their weights as two numbers, this takes a few aggregations of the
   table of sources.
3. Readings that begin before their source's target (virtual start below one) are range-sorted by finish time over all sources;
   the mix is the longest beginning of that queue whose words are within the budget. Only its last reading is needed to tell, for
   each document, how often it is taken: as often as its readings in the queue are not behind that one.

So a source's words differ from its target by less than one of its own documents, unless the budget ends first, which costs the
sources whose last document reaches furthest beyond their target that document.

Running totals, ranks and the sort spread every source over as many partitions as it needs (``running``); nothing but totals
and the last reading goes through the driver.

Defined results: a null text has size 0, documents of size 0 are never taken. Null sources are one source, the empty string
another. Repeated rows are documents of their own. Null ids are allowed. A source without words has target 0. If the budget
is beyond ``repeats`` times all words, everything is taken ``repeats`` times. Empty table: no rows. Columns other than id, source
and text are not read.
"""

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from dossierlens.llm.running import running
from dossierlens.storage import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, REPEATS, PERCENT = (1, 2, 3), 3, 100


def _exact(column):
    return column.cast("decimal(38,0)")


def _targets(sources: DataFrame, budget: int, repeats: int) -> DataFrame:
    """Adds ``target`` (double) and ``stopped`` (the target is at its limit) to rows of size and weight."""
    limit, weight = _exact(F.col("source_size")) * repeats, _exact(F.col("weight"))
    left, open_weight, stopped = budget, None, F.lit(False)
    while True:
        found = sources.agg(F.sum(F.when(stopped, limit)).alias("limits"), F.sum(F.when(~stopped, weight)).alias("weights")).first()
        left, weights = budget - int(found["limits"] or 0), int(found["weights"] or 0)
        if weights == open_weight or weights == 0:
            break
        # A share is left * weight / weights; once stopped, a source stays so, as shares only grow.
        open_weight = weights
        stopped = limit * F.lit(Decimal(weights)) < F.lit(Decimal(left)) * weight
    share = (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(max(weights, 1)))
    return sources.withColumns({"stopped": stopped, "target": F.when(stopped, limit.cast("double")).otherwise(share)})


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS,
                repeats: int = REPEATS, percent: int = PERCENT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix reads the document) of every row."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("shuffle"),
                       F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("content"),
                       F.monotonically_increasing_id().alias("row"))
    placed = running(slim, ["source"], [F.col("shuffle"), F.col("content"), F.col("row")], ["size"], "mix_order")
    totals = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(totals, [], [F.col("source").asc_nulls_last()], [], "mix_sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    sources = ranked.withColumn("weight", weight.cast("long")).withColumnRenamed("position", "source_rank")
    budget = int(sources.agg(F.sum(_exact(F.col("source_size")))).first()[0] or 0) * percent // 100
    targets = stage(_targets(sources, budget, repeats), "mix_targets")
    known = placed.join(targets.select(F.col("source").alias("s_"), "source_size", "source_rank", "target"),
                        F.col("source").eqNullSafe(F.col("s_"))).drop("s_")

    def reading(e):
        finish = (F.lit(e) * F.col("source_size") + F.col("run_size")).cast("double") / F.col("target")
        return F.struct(finish.alias("finish"), F.col("source_rank").alias("source_rank"), F.lit(e).alias("pass"), F.col("position").alias("place"))

    def queued(e):
        begin = F.lit(e) * F.col("source_size") + F.col("run_size") - F.col("size")
        return (F.col("size") > 0) & (begin < F.col("target"))

    kept = ["doc_id", "source", "size", "source_size", "target"]
    if targets.where("not stopped and target > 0").limit(1).count():
        every = F.array_compact(F.array(*[F.when(queued(e), reading(e)) for e in range(repeats)]))
        readings = known.where(queued(0)).select("size", F.inline(every))
        order = ["finish", "source_rank", "pass", "place"]
        queue = running(readings, [], [F.col(c) for c in order], ["size"], "mix_queue")
        cut = queue.where(F.col("run_size") <= budget).agg(F.max(F.struct(*order))).first()[0]
        if cut is None:  # not even the first document is within the budget
            return known.select(*kept, F.lit(0).alias("copies"))
        last = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["source_rank"]).cast("long").alias("source_rank"),
                        F.lit(cut["pass"]).alias("pass"), F.lit(cut["place"]).cast("long").alias("place"))
        return known.select(*kept, sum((F.when(queued(e) & (reading(e) <= last), 1).otherwise(0) for e in range(repeats)), F.lit(0)).alias("copies"))
    return known.select(*kept, F.when(queued(0), repeats).otherwise(0).alias("copies"))


def op13_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS shuffle, md5(coalesce(text, '')) AS content FROM documents),
placed AS (SELECT *, row_number() OVER w - 1 AS place, (sum(size) OVER w)::BIGINT AS run FROM words
  WINDOW w AS (PARTITION BY source ORDER BY shuffle, content ROWS UNBOUNDED PRECEDING)),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr FROM words GROUP BY source),
weighed AS (SELECT *, nr % 3 + 1 AS weight, (sum(source_size) OVER ())::BIGINT AS budget FROM sources),
rounds AS (
  SELECT 0 AS turn, budget AS rest, (SELECT sum(weight) FROM weighed)::BIGINT AS weights FROM (SELECT DISTINCT budget FROM weighed)
  UNION ALL
  SELECT turn + 1, budget - coalesce(n.limits, 0), coalesce(n.weights, 0) FROM (
    SELECT r.turn, w.budget, r.weights AS had, (sum(CASE WHEN 3 * source_size * r.weights < r.rest * weight THEN 3 * source_size END))::BIGINT AS limits,
           (sum(CASE WHEN NOT 3 * source_size * r.weights < r.rest * weight THEN weight END))::BIGINT AS weights
    FROM rounds r, weighed w GROUP BY r.turn, w.budget, r.weights) n WHERE coalesce(n.weights, 0) <> had),
final AS (SELECT rest, weights FROM rounds ORDER BY turn DESC LIMIT 1),
targets AS (SELECT w.*, CASE WHEN 3 * source_size * f.weights < f.rest * weight THEN (3 * source_size)::DOUBLE
                             ELSE (f.rest * weight)::DOUBLE / f.weights::DOUBLE END AS target FROM weighed w, final f),
readings AS (SELECT p.doc_id, p.place, p.source, t.nr, p.size, e, (e * t.source_size + p.run)::DOUBLE / t.target AS finish
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source, range(3) r(e)
  WHERE p.size > 0 AND e * t.source_size + p.run - p.size < t.target),
queue AS (SELECT *, sum(size) OVER (ORDER BY finish, nr, e, place ROWS UNBOUNDED PRECEDING) AS total FROM readings),
taken AS (SELECT source, place, sum(q.size)::BIGINT AS taken FROM queue q WHERE total <= (SELECT max(budget) FROM weighed) GROUP BY ALL)
SELECT p.doc_id, p.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON p.source IS NOT DISTINCT FROM k.source AND p.place = k.place
"""

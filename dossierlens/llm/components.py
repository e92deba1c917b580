"""Connected components of an edge table, by rounds of joins that each end in a written stage."""

from pyspark.sql import DataFrame, functions as F

from dossierlens.storage import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): every id that occurs in ``edges`` (a long, b long) with the smallest id reachable from it.

    Alternates the large-star and small-star steps: every id is linked to the smallest id around it, so that paths halve and
    stars remain. Groups are reduced with ``min`` before the shuffle and joined back, so an id with very many neighbours is
    never gathered. Rounds end when the edge set no longer changes, after a number logarithmic in the longest path.
    """
    pairs = edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage(pairs, "edges")
    sign = F.struct(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")))
    before = None
    while True:
        # large star: neighbours greater than u are linked to the smallest id at or around u
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v"))
        # small star: neighbours at most u, and u itself, are linked to the smallest of them
        large = stage(large.distinct(), "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = (large.join(low, F.col("u") == F.col("k"))
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
                 .where("u <> v").distinct())
        pairs = stage(small, "small_star")
        after = pairs.agg(sign.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)

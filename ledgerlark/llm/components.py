"""Connected components of a link table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(a long, b long) links -> (id, component) for every id in a link; component is the smallest reachable id.

    Every round points each id's neighbours to its smallest neighbour, first the larger ones, then the smaller ones,
    so rounds grow with the logarithm of a component's diameter; they end when all that is left are stars. Links with a
    null end or equal ends are ignored. No link, id or component reaches the driver: only a count does.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while _unsettled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        last, edges = edges, materialize(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        discard(last)
    pairs = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("id"), "component").distinct())


def _unsettled(edges: DataFrame) -> bool:
    """Whether some id points to two others, or to one that points further."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out_"), F.lit(0).alias("in_")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("out_"), F.lit(1).alias("in_")))
    return ends.groupBy("id").agg(F.sum("out_").alias("out_"), F.max("in_").alias("in_")).where("out_ > 1 or out_ + in_ > 1").limit(1).count() > 0

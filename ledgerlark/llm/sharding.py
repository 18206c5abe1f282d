"""Sharding by sampled splitters: near-equal bytes, equal texts together but for those at a shard's boundary.

A key sample weighted by size gives quantile boundaries; rows are dealt into the ranges between them by a hash of the
text, so equal texts share a range. A range that a large group of equal texts overfills is subdivided by document, and
its pieces follow each other. Ranges and pieces in key order then fill the shards by their exact bytes, so a group is
divided only where it crosses a boundary, and no more shards hold parts of it than its size needs, and one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import materialize
from ledgerlark.session import table

#: Least and most ranges for each shard, text bytes for each range between these, and sampled keys for each range. The
#: sample grows with the table up to some million keys.
RANGES, MOST_RANGES, RANGE_BYTES, SAMPLED = 64, 8192, 256 << 20, 16


def _ranges(cuts: np.ndarray):  # noqa: ANN202
    def find(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield pd.Series(np.searchsorted(cuts, k.to_numpy(), "right").astype(np.int32))

    return F.pandas_udf(find, "int")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes (null: none) plus 1. Shards are near equal in bytes: a boundary falls between two
    ranges, each about a 64th of a shard or one row, whichever is more. slot runs from 0 without gaps in each shard, in
    key order; rows that agree in id and text are interchangeable. Null ids come first within their text. An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"), F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("draw"),
    )
    rows = materialize(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = max(RANGES, min(MOST_RANGES, total // (shards * RANGE_BYTES)))
    wanted = shards * ranges * SAMPLED
    # A row is drawn with a probability in proportion to its size; the draw is a hash, so a lost task draws the same rows.
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64("key", "draw", F.lit("draw")), 11) / float(1 << 53) < F.col("size") * (wanted / max(total, 1))).select("key")
    keys = np.sort(drawn.toArrow()["key"].to_numpy())  # about `wanted` keys
    cuts = np.unique(keys[SAMPLED - 1 :: SAMPLED]) if len(keys) else keys
    ranged = rows.withColumn("range", _ranges(cuts)("key"))

    fill = max(1, total // (shards * ranges))
    held = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # A range twice too full is cut again by document.
    held = held.select("range", F.expr(f"case when bytes > {2 * fill} then least(n, bytes div {fill}) else 1 end").alias("pieces"))
    pieces = materialize(ranged.join(F.broadcast(held), "range").withColumn("piece", F.pmod(F.xxhash64("draw"), F.col("pieces"))), "ranged")
    filled = pieces.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # At most some thousand pieces, by the fill that each has at least on average.
    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.select("range", "piece", "n", F.expr("bytes / 2").alias("half"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("ahead"))
    share = max(total, 1) / shards
    filled = filled.withColumn("shard", F.least(F.floor((F.col("ahead") + F.col("half")) / share), F.lit(shards - 1)).cast("int"))
    filled = filled.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = pieces.join(F.broadcast(filled.select("range", "piece", "shard", "offset")), ["range", "piece"])
    order = F.row_number().over(Window.partitionBy("range", "piece").orderBy("key", "id"))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + order - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op6_sampled_splitters": op6_sampled_splitters}

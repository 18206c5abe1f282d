"""Mixing sources to target weights: whole epochs, then Efraimidis-Spirakis sampling of the rest.

Every document draws an exponential key scaled by its quality weight. Within a source, documents in key order fill what
the target leaves after whole epochs. Keys are dealt by sampled ranges, whatever their distribution, and a range starts at
the sum of those before it, so a hot source is never summed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import SPACES, discard, materialize, numbered
from ledgerlark.session import table

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACES}|{SPACES}$", "")
    return F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(SPACES)) + 1).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size) -> source, source_size, target: weighted shares of the sum of sizes, none above most times
    its source's size, the excess reshared by weight. One row per source, so its global windows stay small.

    The fixed point of resharing gives each source min(most * size, level * weight); sources in the order in which they
    reach their limit tell where the level lies.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    named = sizes.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    named = named.withColumns({
        "all": F.sum("source_size").over(everything).cast("double"), "spent": F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)), "rank": F.row_number().over(order),
    })
    # In this order a source stays at its limit as long as the level that it and the later ones would share reaches it.
    named = named.withColumn("level", (F.col("all") - F.col("spent")) / F.col("open"))
    below = F.when(F.col("level") < F.col("limit") / F.col("weight"), F.col("rank"))
    named = named.withColumn("level", F.min_by("level", below).over(everything))
    return named.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, copies, taken, and the columns to carry.

    size counts words. A source takes target div source_size whole epochs of all its documents, then more documents by
    ascending key -ln(u) / weight, each as long as the middle of its words lies within what is left; taken = copies *
    size. u is a hash of seed and id, so reruns agree; quality (id_col, weight > 0) scales the keys, by the
    largest weight of an id, 1 where it has none.
    A null source is a source, last in order; a null text has size 0 and copies of whole epochs only. Rows that repeat an
    id draw the same key and are told apart by size and by what they carry; of rows equal in all of these any may come
    first. An empty table gives an empty result.
    """
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("bigint") + 1) / float((1 << 48) + 1)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw.alias("u"), F.struct(F.lit(0).alias("none"), *carry).alias("carried"))
    rows = words = materialize(rows, "words")
    if quality is not None:
        rows = rows.join(quality.select(F.col(id_col).alias("id"), F.col("weight").cast("double").alias("quality")).where("quality > 0").groupBy("id").agg(F.max("quality").alias("quality")), "id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(1.0))
    rows = rows.withColumn("key", -F.ln("u") / F.coalesce("quality", F.lit(1.0))).drop("u", "quality")

    placed = numbered(rows.withColumnRenamed("source", "of"), "of", ["key", "id", "size", "carried"], "mixed", size="size")
    discard(words)
    goals = targets(placed.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("source_size")), weights, most)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = materialize(goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "goals")
    within = placed.join(goals, F.col("of").eqNullSafe(F.col("source")))
    middle = F.col("pos") + F.col("size") / 2
    more = ((middle <= F.col("rest")) & (F.col("size") > 0) & (F.col("epochs") < most)).cast("bigint")
    copies = (F.col("epochs") + more).cast("bigint")
    return within.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(F.col(f"carried.{c}").alias(c) for c in carry))


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 2 for good documents, 1/4 for bad ones."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.when(F.min("quality") == 1, 2.0).otherwise(0.25).alias("weight"))


def op8_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), label_weights(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_weighted_mix": op8_weighted_mix}

ORACLE_SQL = {
    "op8_weighted_mix": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 1) / 281474976710657.0 AS u FROM documents
        ), q AS (SELECT doc_id, CASE WHEN min(quality) = 1 THEN 2.0 ELSE 0.25 END AS w FROM labels WHERE quality IS NOT NULL GROUP BY 1
        ), k AS (SELECT d.doc_id, source, size, -ln(CAST(u AS DOUBLE)) / CAST(coalesce(w, 1.0) AS DOUBLE) AS key FROM d LEFT JOIN q USING (doc_id)
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) * 3 AS DOUBLE) AS lim,
                   CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM k GROUP BY source
        ), o AS (
            SELECT *, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS rank,
                   (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s
        ), g AS (
            SELECT source, source_size, least(lim, coalesce((SELECT min_by(level, rank) FROM o WHERE level < lim / weight) * weight, lim)) AS target FROM o
        ), t AS (
            SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
                   coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
        )
        SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN ahead + size / 2 <= target - epochs * source_size AND size > 0 AND epochs < 3 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM t
    """,
}

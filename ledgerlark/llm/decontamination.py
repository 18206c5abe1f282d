"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

An item of n shingles contained by share c in a document shares at least one of any n - ceil(c * n) + 1 of them. An
item's sketch is that many of its smallest shingle hashes, a bottom-k MinHash whose k follows the item's size, so a
short item is found inside a document of any length. Items are partitioned by size into powers of two: in each partition
that fits into a document, it looks up its hashes under the largest of that partition's sketches, so the many hashes
that short items need are not looked up among long ones. Candidates are verified by their shingles' words. Everything
is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import materialize
from ledgerlark.session import table

SHINGLE = 5


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _from(a: str, k: int) -> Column:
    return F.expr(f"slice({a}, {k + 1}, greatest(size({a}) - {k}, 0))")


def _to(a: str, k: int) -> Column:
    return F.expr(f"slice({a}, 1, greatest(size({a}) - {k}, 0))")


def with_shingle_hashes(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the distinct 64-bit hashes of the five-word shingles, by pairing hashes of words, pairs and fours."""
    def pair(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    df = df.withColumn("_h1", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("_h2", F.zip_with(_to("_h1", 1), _from("_h1", 1), pair))
    df = df.withColumn("_h4", F.zip_with(_to("_h2", 2), _from("_h2", 2), pair))
    df = df.withColumn("_h5", F.zip_with(_to("_h4", 1), _from("_h1", 4), pair))
    return df.withColumn(out, F.array_distinct("_h5")).drop("_h1", "_h2", "_h4", "_h5")


def with_shingles(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the distinct five-word shingles as strings."""
    windows = F.transform(F.expr(f"sequence(1, size({words}) - {SHINGLE - 1})"), lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " "))
    return df.withColumn(out, F.when(F.size(words) >= SHINGLE, F.array_distinct(windows)).otherwise(F.expr("array()").cast("array<string>")))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, item_id, n_item, n_common, containment for every document that holds
    at least percent of an item's distinct five-word shingles; words are lower-cased runs of letters and digits.

    An item or a document of fewer than five words, or with a null text or id, matches nothing. Rows that repeat an id
    count as one document or item with the shingles of all of them. No match, or an empty table: an empty result.
    """
    listed = items.where("item_id is not null and text is not null").select("item_id", plain_words(F.col("text")).alias("words"))
    listed = with_shingles(listed, "words", "shingles").select("item_id", F.explode_outer("shingles").alias("shingle")).where("shingle is not null").distinct()
    listed = materialize(listed, "items")
    sizes = materialize(listed.groupBy("item_id").agg(F.count("*").alias("n_item")), "item-sizes")

    sketched = items.where("item_id is not null and text is not null").select("item_id", plain_words(F.col("text")).alias("words"))
    sketched = with_shingle_hashes(sketched, "words", "h").select("item_id", F.explode_outer("h").alias("h")).where("h is not null").distinct()
    hashes = sketched.groupBy("item_id").agg(F.sort_array(F.collect_list("h")).alias("h"))
    hashes = hashes.withColumn("kept", F.expr(f"size(h) - cast(ceil(size(h) * {percent} / 100) as int) + 1"))
    # The size class is the smallest document that can hold so much of an item of its class, as a power of two.
    hashes = hashes.withColumn("least", F.expr(f"shiftleft(1, cast(floor(log2(ceil(size(h) * {percent} / 100))) as int))"))
    sketches = materialize(hashes.select(F.explode(F.slice("h", 1, F.col("kept"))).alias("h"), "item_id", "least"), "sketches")
    bounds = [(r["least"], r["most"]) for r in sketches.groupBy("least").agg(F.max("h").alias("most")).orderBy("least").collect()]  # a row for each power of two
    if not bounds:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0).cast("bigint").alias("n_item"), F.lit(0).cast("bigint").alias("n_common"), F.lit(0.0).alias("containment")).where("false")

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    # No condition on h itself: it would be pushed below the steps that make h, and so repeat them.
    hashed = with_shingle_hashes(rows.select("doc_id", plain_words(F.col("text")).alias("words")), "words", "h").withColumn("held", F.size("h"))
    under = lambda least, most: F.when(F.col("held") >= least, F.transform(F.filter("h", lambda x: x <= most), lambda x: F.struct(F.lit(least).alias("least"), x.alias("h"))))
    parts = F.flatten(F.array_compact(F.array(*(under(least, most) for least, most in bounds))))
    low = hashed.select("doc_id", F.explode(parts).alias("low")).select("doc_id", "low.least", "low.h")
    near = low.join(sketches.select("least", "h").distinct(), ["least", "h"], "left_semi").select("doc_id").distinct()
    near = materialize(near, "near")

    texts = rows.join(near, "doc_id", "left_semi").select("doc_id", plain_words(F.col("text")).alias("words"))
    texts = with_shingles(texts, "words", "shingles").select("doc_id", F.explode_outer("shingles").alias("shingle"))
    common = texts.join(listed, "shingle").groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("n_common"))
    found = common.join(sizes, "item_id").where(F.col("n_common") * 100 >= F.col("n_item") * percent)
    return found.select("doc_id", "item_id", "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))


def op5_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_minhash_containment": op5_minhash_containment}

ORACLE_SQL = {
    "op5_minhash_containment": r"""
        WITH t AS (
            SELECT 0 AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
            UNION ALL SELECT 1, item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
        ), w AS (SELECT kind, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM t
        ), s AS (
            SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS sh FROM w
        ), i AS (SELECT id AS item_id, sh, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE kind = 1
        )
        SELECT s.id AS doc_id, item_id, n_item, count(*) AS n_common, count(*) / CAST(n_item AS DOUBLE) AS containment
        FROM s JOIN i USING (sh) WHERE kind = 0 GROUP BY s.id, item_id, n_item HAVING count(*) * 100 >= n_item * 80
    """,
}

"""The training-data pipeline over documents: five stages, each written as Parquet and read by the next.

A row is told apart by a hash of its id and text, so that null and repeated ids are handled like any other. Every stage
but the last returns the columns that it got, extra ones included, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import decontamination, jaccard_join, mixing, quality_classifier, sharding
from ledgerlark.llm.common import discard, materialize
from ledgerlark.session import table


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that is equal for rows of equal id and text, and its name."""
    key = _free(docs, "row_key")
    return docs.withColumn(key, F.xxhash64(F.struct("doc_id", "text"))), key


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the neighbours' votes reject, as op4 predicts.

    A null, empty or very short text scores the labelled sample's base rate and stays if that is accepted; rows that repeat
    an id or text are judged alike, each by its own text; without labels or rows nothing is rejected.
    """
    out = _free(docs, "quality_score")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    if not len(model.labels):
        return docs
    return quality_classifier.score(docs, model, docs.columns, out=out).where(F.col(out) >= quality_classifier.ACCEPTED).drop(out)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a Jaccard similarity of 0.8 or more, that of the smallest id stays.

    Rows of equal id and text are one document, of which one row stays. A null id comes after all others; of equal ids
    in a group the smallest hash of the row stays. Null and wordless texts are linked with nothing. An empty table stays
    empty.
    """
    docs, key = _keyed(docs)
    linked = jaccard_join.jaccard_join(docs.select(key, "text"), k=5, percent=80, id_col=key, links=False)
    ids = docs.groupBy(key).agg(F.first("doc_id").alias("doc_id"))
    first = linked.select(key, "component_id").distinct().join(ids, key).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("best"))
    kept = first.select(F.col(f"best.{key}").alias(key))
    return docs.join(kept.hint("merge"), key, "left_semi").dropDuplicates([key]).drop(key)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item, whatever their id. Null texts, and texts or items of fewer than
    five words, hold and match nothing. Repeated rows go or stay together. An empty table stays empty."""
    docs, key = _keyed(docs)
    leaks = decontamination.contained_items(docs.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(leaks, key, "left_anti").drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, so zero to three times.

    A null or empty text has no words and comes as often as whole epochs of its source. Rows of equal id and text have
    the same key; each comes as often as the mix takes the one that it takes most often. A null source is a source. An
    empty table stays empty.
    """
    docs, key = _keyed(docs)
    n = _free(docs, "copies")
    taken = mixing.mix(docs, mixing.label_weights(table(spark, sf_dir, "labels")), carry=(key,))
    copies = taken.groupBy(key).agg(F.max("copies").alias(n)).where(F.col(n) > 0)
    many = docs.join(copies, key).withColumn(n, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))))
    return many.drop(n, key)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix. Null texts have size 1; repeated rows get a slot each; an empty table
    gives an empty result."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", deal_shards),
]

#: The classifier's votes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

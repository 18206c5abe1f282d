"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents gives tf-idf weights, the latent space and the labelled vectors. These are
broadcast; every document's vector is compared with all of them by blocked matrix products, and the nearest labels vote
with weights by cosine similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import buffers, held_out, materialize
from ledgerlark.session import table


#: Scores from here on are accepted.
ACCEPTED = 0.7
#: Documents whose vectors are compared with the labelled ones in one product.
SLICE = 512


@dataclass(frozen=True)
class Model:
    """Bounded by the sample: idf (buckets), axes (buckets x rank), vectors (sample x rank), labels (sample)."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float
    neighbours: int
    sharpness: float


def hashed_counts(buf: np.ndarray, offs: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of counts of hashed byte trigrams; none crosses documents."""
    n = len(offs) - 1
    if len(buf) < 3:
        return np.zeros((n, buckets), dtype=np.float32)
    b = buf.astype(np.uint32)
    code = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - int(buckets).bit_length() + 1)
    where = np.repeat(np.arange(n, dtype=np.int64) * buckets, np.diff(offs))[:-2] + code
    crossing = np.concatenate([offs[1:-1] - 1, offs[1:-1] - 2])
    keep = np.ones(len(where), dtype=bool)
    keep[crossing[(crossing >= 0) & (crossing < len(where))]] = False
    return np.bincount(where[keep], minlength=n * buckets)[: n * buckets].reshape(n, buckets).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in buffers(batch.column("text"), slice_rows=SLICE):
            rows = hashed_counts(buf, offs, buckets)
            yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(lo, hi - lo) for x in ("place", "quality")), pa.array([r.tobytes() for r in rows], pa.binary())], names=["place", "quality", "counts"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4096, buckets: int = 2048, rank: int = 64, neighbours: int = 15, sharpness: float = 4.0) -> Model:
    """Learns from at most sample labelled documents, those of the smallest id hashes outside the held-out fold. Of
    several labels for an id the lowest counts, of several texts for an id that of the smallest hash; null labels and
    texts don't count. The sample is put in the order of id hash and id, so that partitions and arrival change nothing."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    there = docs.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("t"))
    chosen = marks.join(there, "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "t", "quality").orderBy("h", "doc_id").limit(sample)
    chosen = materialize(chosen.withColumn("place", F.row_number().over(Window.orderBy("h", "doc_id"))), "sample")
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").where("text is not null").join(F.broadcast(chosen), ["doc_id", "t"]).dropDuplicates(["place"]).select("place", "quality", "text")
    rows = sorted(texts.mapInArrow(lambda it: _counted(it, buckets), "place int, quality int, counts binary").collect())  # at most sample rows
    y = np.array([r[1] for r in rows], dtype=np.float32)
    x = np.log1p(np.array([np.frombuffer(r[2], dtype=np.float32) for r in rows], dtype=np.float32).reshape(-1, buckets))
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = unit(x * idf)
    draws = np.random.Generator(np.random.PCG64(7)).standard_normal((buckets, rank + 16), dtype=np.float32)
    span = np.linalg.qr(x.T @ (x @ draws))[0] if len(x) else np.linalg.qr(draws)[0]
    for _ in range(2):
        span = np.linalg.qr(x.T @ (x @ span))[0] if len(x) else span
    within = np.linalg.svd(x @ span, full_matrices=False)[2] if len(x) else np.eye(span.shape[1], dtype=np.float32)
    axes = np.ascontiguousarray((span @ within.T)[:, :rank], dtype=np.float32)
    return Model(idf, axes, unit(x @ axes), y, float(y.mean()) if len(y) else 0.5, neighbours, sharpness)


def votes(model: Model, vectors: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest; the base rate for a zero vector. Of equally near labelled
    vectors at the last place the first in the sample's order count."""
    out = np.full(len(vectors), model.base)
    if not len(model.labels):
        return out
    near = vectors @ model.vectors.T
    k = min(model.neighbours, near.shape[1])
    at = np.tile(np.arange(k), (len(near), 1))
    if k < near.shape[1]:
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        above = near > last
        level = near == last
        taken = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        at = np.nonzero(taken)[1].reshape(len(near), k)
    weight = np.clip(np.take_along_axis(near, at, axis=1), 0, 1).astype(np.float64) ** model.sharpness
    total = weight.sum(axis=1)
    voted = total > 1e-9
    out[voted] = (weight * model.labels[at]).sum(axis=1)[voted] / total[voted]
    return np.clip(out, 0.0, 1.0)


def _scored(batches: Iterator[pa.RecordBatch], model, text: str, kept: list[str], out: str) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    m: Model = model.value
    for batch in batches:
        for lo, hi, buf, offs in buffers(batch.column(text), slice_rows=SLICE):
            x = np.log1p(hashed_counts(buf, offs, len(m.idf))) * m.idf
            score = votes(m, unit(unit(x) @ m.axes))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(lo, hi - lo) for n in kept), pa.array(score)], names=[*kept, out])


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """One row per row of docs: the carried columns and out, how likely label 1 is, from the text alone.

    An empty or null text scores the sample's base rate; without any labelled row everything scores 0.5. Repeated rows
    score alike; an empty table gives an empty result.
    """
    rows = docs.select(*dict.fromkeys([*carry, text_col]))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + f", `{out}` double"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda it: _scored(it, shared, text_col, carry, out), schema)


def op4_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


QUERIES = {"op4_neighbour_votes": op4_neighbour_votes}

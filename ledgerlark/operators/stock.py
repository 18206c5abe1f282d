"""Stock guard: requests for goods in order of time, each served whole or refused without using anything up."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moves sorted by product and order, from the stock that each product starts with. Products follow each other in the
    batches, so that one costs no call of its own."""
    product = left = None
    for b in batches:
        accepted, lefts = [], []
        for goods, start, delta in zip(*(b.column(c).to_pylist() for c in ("goods_id", "number", "delta")), strict=True):
            if goods != product:
                product, left = goods, start
            fits = left is not None and (delta >= 0 or left + delta >= 0)
            if fits:
                left += delta
            accepted.append(fits)
            lefts.append(left)
        rest = {c: b.column(c) for c in b.schema.names if c != "number"}
        yield pa.RecordBatch.from_pydict(rest | {"accepted": pa.array(accepted, pa.bool_()), "stock_left": pa.array(lefts, pa.int64())})


def allocate(stock: DataFrame, moves: DataFrame, folder: str, block_rows: int = 500_000) -> DataFrame:
    """stock (goods_id, number), moves (goods_id, at, id, delta) -> goods_id, at, id, delta, accepted, stock_left: a negative
    delta takes from the stock and is refused where too little is left; a later, smaller one may still fit. Returned goods
    are always taken back. Order: at (null first), then id, which is unique. Stock rows of one product add up. Moves of a
    product that the stock lacks, or with a null product or delta, are refused and have no stock_left.

    Moves are dealt by ranges of (product, time, id), so that a product in demand covers several ranges; each range holds
    about block_rows rows. The first piece of every product is served in one job, the second pieces in the next, which
    starts from the stock that the first left, and so on: as many jobs as the most wanted product has pieces, and no task
    with more than one piece of a product. Pieces and results are written to the folder, which executors share."""
    spark = moves.sparkSession
    columns = ["goods_id", "at", "id", "delta"]
    moves = moves.select("goods_id", "at", "id", F.col("delta").cast("bigint").alias("delta"))
    void = F.col("goods_id").isNull() | F.col("delta").isNull()
    blocks = max(1, -(-moves.where(~void).count() // block_rows))
    moves.where(~void).repartitionByRange(blocks, "goods_id", "at", "id").withColumn("block", F.spark_partition_id()).write.parquet(f"{folder}/blocks")
    placed = spark.read.parquet(f"{folder}/blocks")
    spans = placed.groupBy("goods_id", "block").agg(F.count("*").alias("n")).groupBy("goods_id").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    later = spans.where(F.size("blocks") > 1).select("goods_id", F.posexplode("blocks").alias("turn", "block"))  # at most two rows a block
    turned = placed.join(later, ["goods_id", "block"], "left").select(*columns, F.coalesce("turn", F.lit(0)).alias("turn"))
    turned.write.partitionBy("turn").parquet(f"{folder}/turns")
    pieces = spark.read.schema(turned.schema).parquet(f"{folder}/turns")
    turns = later.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0] + 1
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in moves.schema)}, accepted boolean, stock_left bigint"
    state = stock.groupBy("goods_id").agg(F.sum("number").cast("bigint").alias("number"))
    for turn in range(turns):
        piece = pieces.where(F.col("turn") == turn).drop("turn").join(state, "goods_id", "left")
        piece.repartition("goods_id").sortWithinPartitions("goods_id", "at", "id").mapInArrow(_served, schema).write.parquet(f"{folder}/served/turn={turn}")
        done = spark.read.parquet(f"{folder}/served/turn={turn}")
        state = done.groupBy("goods_id").agg(F.max_by("stock_left", F.struct("at", "id")).alias("number"))
    refused = moves.where(void).select(*columns, F.lit(False).alias("accepted"), F.lit(None).cast("bigint").alias("stock_left"))
    return spark.read.schema(f"{schema}, turn int").parquet(f"{folder}/served").drop("turn").unionByName(refused)

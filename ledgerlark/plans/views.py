"""The commerce and review tables as they are derived from the given tables, for Spark and for the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.session import table

#: The days up to which the given tables run.
AS_OF_ORDERS, AS_OF_EVENTS = "2001-08-02", "2024-01-31"


def orders(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", 401).when(F.col("o_orderstatus") == "P", 402).otherwise(101)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
        F.col("o_orderdate").alias("created"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_orderkey") % 17 == 0).alias("deleted"), F.col("o_orderpriority").alias("priority"),
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("goods_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").cast("int").alias("number"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("state"), F.col("l_shipdate").alias("shipped"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 17 == 0).alias("deleted"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.floor("value").cast("bigint").alias("duration_ms"), F.col("ts").alias("created"), (F.col("user_id") % 4).alias("role_no"), (F.col("event_id") % 10 == 0).alias("is_replay"), "props",
    )


def analyses(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "neutral")
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("product_id"), "text", "source", "lang", (F.col("doc_id") % 5 + 1).cast("int").alias("rating"), label.alias("label"),
        (F.col("doc_id") % 100 / 100).cast("decimal(6,4)").alias("confidence"), (F.col("doc_id") * 7 % 100 / 100).cast("decimal(6,4)").alias("negative_score"),
        F.expr("date_add(date'2024-01-01', cast(doc_id % 31 as int))").alias("day"), (F.col("doc_id") % 17 == 0).alias("deleted"),
    )


ORD = """ord AS (
    SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 401 WHEN 'P' THEN 402 ELSE 101 END AS status, CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
           o_orderdate AS created, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 17 = 0 AS deleted, o_orderpriority AS priority FROM orders)"""
LIN = """lin AS (
    SELECT l_orderkey AS order_id, l_partkey AS goods_id, l_suppkey AS supplier_id, l_linenumber AS line_no, CAST(l_quantity AS INTEGER) AS number,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS price, l_returnflag AS flag, l_linestatus AS state, l_shipdate AS shipped, (l_orderkey + l_linenumber) % 17 = 0 AS deleted FROM lineitem)"""
RUN = """run AS (
    SELECT event_id AS id, user_id, event_type AS tool, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, CAST(floor(value) AS BIGINT) AS duration_ms,
           ts AS created, user_id % 4 AS role_no, event_id % 10 = 0 AS is_replay, props FROM events)"""
ANA = """ana AS (
    SELECT d.doc_id AS id, d.doc_id % 50 AS product_id, text, source, lang, CAST(d.doc_id % 5 + 1 AS INTEGER) AS rating,
           CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END AS label,
           CAST((d.doc_id % 100) / 100 AS DECIMAL(6,4)) AS confidence, CAST((d.doc_id * 7 % 100) / 100 AS DECIMAL(6,4)) AS negative_score,
           CAST(DATE '2024-01-01' + CAST(d.doc_id % 31 AS INTEGER) AS DATE) AS day, d.doc_id % 17 = 0 AS deleted
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

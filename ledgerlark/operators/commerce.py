"""Joins, rankings and state changes of the shop: lookups, anti-joins, trees, coupons, pricing and workflows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import count_if


#: Order lines that one task sorts and nests at most, roughly.
LINES_A_TASK = 500_000


def _dealt(lines: DataFrame, rows: int) -> Callable[[DataFrame, str], DataFrame]:
    """Deals rows by order into so many tasks that none has many more than `rows` lines, however many there are in all."""
    spark = lines.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // rows))
    return lambda df, key: df.repartition(tasks, key)


def order_ids(orders: DataFrame, users: DataFrame, lines: DataFrame, user: Column | None = None, rows: int = LINES_A_TASK) -> DataFrame:
    """Orders with a live line, once each: the test on the lines makes the outer joins inner."""
    dealt = _dealt(lines, rows)
    joined = orders.join(users, "user_id", "left")
    joined = (joined.where(user) if user is not None else joined).select("id")
    return dealt(joined, "id").join(dealt(lines.where(~F.col("deleted")).select(F.col("order_id").alias("id")), "id"), "id", "left_semi").distinct()


def order_details(page: DataFrame, orders: DataFrame, users: DataFrame, lines: DataFrame, rows: int = LINES_A_TASK) -> DataFrame:
    """The orders of a page of ids with their user and live lines in order, as nested rows."""
    dealt = _dealt(lines, rows)
    page = dealt(page, "id")
    nested = dealt(lines.where(~F.col("deleted")).withColumnRenamed("order_id", "id"), "id").join(page, "id", "left_semi").groupBy("id")
    goods = nested.agg(F.sort_array(F.collect_list(F.struct("line_no", "goods_id", "number", "price"))).alias("goods"))
    named = dealt(orders, "id").join(page, "id", "left_semi").join(users, "user_id", "left")
    return dealt(named, "id").join(goods, "id", "left")


def pending(latest: DataFrame, done: DataFrame, key: str, n: int, *sort: Column, over_fetch: int = 5) -> DataFrame:
    """At most n rows not yet done, out of the first over_fetch * n."""
    return latest.orderBy(*sort).limit(over_fetch * n).join(done.select(key), key, "left_anti").orderBy(*sort).limit(n)


def lookup(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """A left lookup; missing rows give defaults, or nulls."""
    out = left.join(right, key, "left")
    return out.fillna(defaults) if defaults else out


def polymorphic(refs: DataFrame, goods: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, type, value_id) with the name of goods for type 0, else of a topic."""
    g = goods.select(F.col("id").alias("value_id"), F.lit(0).alias("kind"), F.col("name").alias("goods_name"))
    t = topics.select(F.col("id").alias("value_id"), F.lit(1).alias("kind"), F.col("name").alias("topic_name"))
    kind = F.when(F.col("type") == 0, 0).otherwise(1)
    out = refs.withColumn("kind", kind).join(g, ["value_id", "kind"], "left").join(t, ["value_id", "kind"], "left")
    return out.select("id", "type", "value_id", F.coalesce("goods_name", "topic_name").alias("name"))


def tree(parents: DataFrame, children: DataFrame, leaves: DataFrame) -> DataFrame:
    """Three levels (key, name[, up]) as one row per path; parents without children stay."""
    p = parents.select(F.col("key").alias("k1"), F.col("name").alias("level1"))
    c = children.select(F.col("key").alias("k2"), F.col("name").alias("level2"), F.col("up").alias("k1"))
    n = leaves.groupBy(F.col("up").alias("k2")).agg(F.count("*").alias("leaves"))
    return p.join(c, "k1", "left").join(n, "k2", "left").select("level1", "level2", F.coalesce("leaves", F.lit(0)).alias("leaves"))


def latest_per_key(df: DataFrame, key: str, by: str) -> DataFrame:
    """The row with the largest by of each key, without sorting groups."""
    row = F.max_by(F.struct(*df.columns), by)
    return df.groupBy(key).agg(row.alias("_r")).select("_r.*")


def first_per_key(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row with the smallest by of each key; rows with a null in the key are all kept, as unique keys have it."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    once = df.where(~null).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), by).alias("_r")).select("_r.*")
    return once.unionByName(df.where(null))


def top_per_group(df: DataFrame, group: str, n: int, *sort: Column) -> DataFrame:
    """The first n rows of each group; the rank limit is applied before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*sort))).where(F.col("rank") <= n)


def min_max(df: DataFrame, group: str, score: str) -> DataFrame:
    """Scores scaled to 0..1 within each group; all equal: 1 when positive, else 0."""
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    flat = F.when(F.col(score) > 0, 1.0).otherwise(0.0)
    return df.withColumn("scaled", F.when(high <= low, flat).otherwise((F.col(score) - low) / F.nullif(high - low, F.lit(0.0))))


def rolling_failures(runs: DataFrame, key: str, width: int = 10, most: int = 3) -> DataFrame:
    """Failures among the last width runs of a key, and whether the breaker opens."""
    w = Window.partitionBy(key).orderBy("created", "id").rowsBetween(-(width - 1), 0)
    failures = F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).over(w)
    return runs.select("id", key, failures.alias("failures"), (failures >= most).alias("open"))


def eligible_coupons(coupons: DataFrame, carts: DataFrame) -> DataFrame:
    """(coupon_id, user_id, discount, least, kind, scope array, starts, ends) x (user_id, goods_id, category, amount, day) ->
    each user's valid coupons with the amount they apply to. kind 0 takes all goods, 1 a category list, 2 a goods list."""
    in_scope = (F.col("kind") == 0) | ((F.col("kind") == 1) & F.array_contains("scope", F.col("category"))) | ((F.col("kind") == 2) & F.array_contains("scope", F.col("goods_id")))
    pairs = coupons.join(carts, "user_id").where(in_scope & F.col("day").between(F.col("starts"), F.col("ends")))
    summed = pairs.groupBy("user_id", "coupon_id", "discount", "least").agg(F.sum("amount").alias("amount"))
    return summed.where(F.col("amount") >= F.col("least"))


def best_coupon(valid: DataFrame) -> DataFrame:
    """Per user the coupon with the largest discount; ties go to the smaller id."""
    return valid.groupBy("user_id").agg(F.max_by("coupon_id", F.struct("discount", -F.col("coupon_id"))).alias("coupon_id"), F.max("discount").alias("discount"))


def price_orders(lines: DataFrame, discounts: DataFrame, freight: str = "8.00", free_from: str = "88.00") -> DataFrame:
    """Per order: goods amount, freight below the limit, discount, and what is paid, never below zero."""
    goods = lines.groupBy("order_id").agg(F.sum(F.col("price") * F.col("number")).alias("goods"))
    priced = goods.join(discounts, "order_id", "left").withColumn("discount", F.coalesce("discount", F.lit("0.00").cast("decimal(12,2)")))
    fee = F.when(F.col("goods") < F.lit(free_from).cast("decimal(12,2)"), F.lit(freight).cast("decimal(12,2)")).otherwise(F.lit("0.00").cast("decimal(12,2)"))
    paid = F.greatest(F.lit(0).cast("decimal(38,2)"), (F.col("goods") + fee - F.col("discount")).cast("decimal(38,2)"))
    return priced.select("order_id", F.col("goods").cast("double").alias("goods"), fee.cast("double").alias("freight"), F.col("discount").cast("double").alias("discount"), paid.cast("double").alias("paid"))


def apply_stock(stock: DataFrame, changes: DataFrame) -> DataFrame:
    """(goods_id, number) with signed changes (goods_id, delta) folded in; a change that would leave less than zero is
    refused as a whole."""
    folded = changes.groupBy("goods_id").agg(F.sum("delta").alias("delta"))
    out = stock.join(folded, "goods_id", "left").withColumn("delta", F.coalesce("delta", F.lit(0)))
    fits = F.col("number") + F.col("delta") >= 0
    return out.select("goods_id", F.when(fits, F.col("number") + F.col("delta")).otherwise(F.col("number")).alias("number"), fits.alias("applied"))


def transitions(orders: DataFrame, moves: DataFrame, legal: list[tuple[int, str, int]]) -> DataFrame:
    """Orders after their moves (id, action): the new status where the table of legal moves has one, else the old."""
    step = F.lit(None).cast("int")
    for status, action, to in legal:
        step = F.when((F.col("status") == status) & (F.col("action") == action), to).otherwise(step)
    moved = orders.join(moves, "id", "left").withColumn("_to", step)
    return moved.select("id", "status", F.coalesce("_to", "status").alias("new_status"), (F.col("action").isNotNull() & F.col("_to").isNull()).alias("refused"))


def expired(orders: DataFrame, as_of: str, days: int, status: int) -> DataFrame:
    """Orders of a status that are at least days old."""
    return orders.where((F.col("status") == status) & (F.to_date("created") <= F.date_sub(F.to_date(F.lit(as_of)), days)))


def compare_runs(runs: DataFrame, pairs: DataFrame, fields: list[str], score: str) -> DataFrame:
    """(left_id, right_id) with a flag for each field that differs, null-safe, and the rounded difference of the score."""
    left, right = runs.select(*(F.col(c).alias(f"l_{c}") for c in ["id", *fields, score])), runs.select(*(F.col(c).alias(f"r_{c}") for c in ["id", *fields, score]))
    both = pairs.join(left, pairs["left_id"] == left["l_id"]).join(right, pairs["right_id"] == right["r_id"])
    return both.select("left_id", "right_id", *((~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias(f"{c}_changed") for c in fields), F.round((F.col(f"r_{score}") - F.col(f"l_{score}")).cast("decimal(18,4)"), 4).cast("double").alias("score_change"))


def unregistered(calls: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Calls by key of those that the registry lacks; the counts shrink before the anti-join."""
    return calls.groupBy(key).agg(F.count("*").alias("total")).join(registry.select(key), key, "left_anti")


def overlap(df: DataFrame, split: str, key: Column) -> DataFrame:
    """Pairs of splits and the number of keys they share, from one aggregation of key to its set of splits."""
    sets = df.groupBy(key.alias("k")).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows of batch to append: the first of each key that the target lacks; a null in the key never clashes."""
    return first_per_key(batch, keys, by).join(target.select(*keys).distinct(), keys, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """The target with new rows added, and the updated columns replaced where the key is there."""
    t, b = target.alias("t"), batch.alias("b")
    there, new = F.col(f"t.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    cols = [F.coalesce(f"t.{key}", f"b.{key}").alias(key)]
    for c in target.columns:
        if c != key:
            cols.append((F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")) if c in updated else F.when(there, F.col(f"t.{c}")).otherwise(F.col(f"b.{c}"))).alias(c))
    return t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full").select(*cols)


def severity_matrix(findings: DataFrame, excepted: DataFrame, keys: list[str], severity: str) -> DataFrame:
    """Findings by severity, split into those with and without an exception (composite key, null as '')."""
    flat = lambda df: df.select("*", F.concat_ws("\x01", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).alias("_key"))
    known = flat(excepted).select("_key", F.lit(True).alias("_known")).distinct()
    both = flat(findings).join(known, "_key", "left")
    return both.groupBy(severity).agg(count_if(F.col("_known")).alias("excepted"), count_if(F.col("_known").isNull()).alias("open"))

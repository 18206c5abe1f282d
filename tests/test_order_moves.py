"""Order histories against a loop over all moves."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerlark.operators import order_moves as M

MOVES = "order_id long, at int, id long, action string"


def looped(status, moves):
    steps, out, now = {(a, x): b for a, x, b in M.LEGAL}, {}, dict(status)
    for order, _, i, action in sorted(moves, key=lambda m: (m[1] is not None, m[1] or 0, m[2])):
        if order is None:
            out[i] = (None, None, False)
            continue
        before = now.get(order, M.ABSENT)
        now[order] = steps.get((before, action), before)
        out[i] = (before, now[order], (before, action) in steps)
    return out


def test_histories_equal_a_loop_and_a_hot_order_is_split(spark, tmp_path):
    rng = random.Random(5)
    actions = sorted({x for _, x, _ in M.LEGAL}) + ["fly", None]
    moves = [(1 if rng.random() < 0.4 else rng.choice([*range(2, 60), None]), rng.choice([None, *range(400)]), i, rng.choice(actions)) for i in range(4000)]
    status = {2: 101, 3: 999, 4: 401, 5: 0, 6: 201}
    orders = spark.createDataFrame([*status.items(), (2, 0), (None, 7)], "order_id long, status int").withColumn("block", F.lit("x"))
    frame = spark.createDataFrame(moves, MOVES).withColumn("start", F.lit("x")).repartition(5)
    for size in (150, 100_000):
        folder = str(tmp_path / str(size))
        got = M.moved(orders, frame, folder, block_rows=size)
        assert got.columns == ["order_id", "at", "id", "action", "before", "after", "accepted"]
        assert {r.id: (r.before, r.after, r.accepted) for r in got.collect()} == looped(status, moves)
        pieces = spark.read.parquet(f"{folder}/blocks").groupBy("block").agg(F.count("*").alias("n"), F.count(F.when(F.col("key") == 1, 1)).alias("hot")).collect()
        assert size > 150 or (sum(p.hot > 0 for p in pieces) > 5 and max(p.n for p in pieces) < 3 * size)


def test_a_row_of_blocks_goes_on_where_the_one_before_ended(spark, tmp_path):
    circle = ((0, "a", 1), (1, "a", 2), (2, "a", 0), (1, "b", 0))
    actions = ["a", "a", "b", "b", "a"]
    moves = [(7, i, i, actions[i % 5]) for i in range(500)]
    got = M.moved(spark.createDataFrame([], "order_id long, status int"), spark.createDataFrame(moves, MOVES), str(tmp_path / "x"), legal=circle, block_rows=40)
    steps, now, want = {(a, x): b for a, x, b in circle}, 0, []
    for _, _, _, action in moves:
        now = steps.get((now, action), now)
        want.append(now)
    assert [r.after for r in got.orderBy("id").collect()] == want


def test_empty_moves(spark, tmp_path):
    assert M.moved(spark.createDataFrame([(1, 101)], "order_id long, status int"), spark.createDataFrame([], MOVES), str(tmp_path / "x")).count() == 0


def test_stock_and_coupons_follow_accepted_moves(spark, tmp_path):
    moves = [(1, 1, 1, "submit"), (1, 2, 2, "pay"), (1, 3, 3, "refund"), (1, 4, 4, "refund_confirm"), (2, 1, 5, "submit"), (2, 2, 6, "submit"), (3, 1, 7, "cancel"), (4, 1, 8, "submit"), (4, 2, 9, "cancel"), (4, 3, 10, "pay"), (4, 4, 11, "cancel")]
    done = M.moved(spark.createDataFrame([], "order_id long, status int"), spark.createDataFrame(moves, MOVES), str(tmp_path / "x"))
    lines = spark.createDataFrame([(1, 10, 2), (1, 11, 3), (2, 10, 4), (3, 10, 5), (4, 12, 1)], "order_id long, goods_id long, number int")
    felt = {(r.goods_id, r.id): r.delta for r in M.stock_moves(done, lines).collect()}
    assert felt == {(10, 1): -2, (11, 1): -3, (10, 4): 2, (11, 4): 3, (10, 5): -4, (12, 8): -1, (12, 9): 1}
    coupons = spark.createDataFrame([(50, 1), (51, 2), (52, 3), (53, 4), (54, None), (55, 2)], "coupon_id long, order_id long")
    told = {r.coupon_id: (r.status, r.times_used) for r in M.coupon_states(done, coupons).collect()}
    assert told == {50: ("usable", 1), 51: ("used", 1), 52: ("usable", 0), 53: ("usable", 1), 54: ("usable", 0), 55: ("used", 1)}

"""Orders through their lives: actions in order of time against a table of legal moves, and what they do to stock and coupons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The state of an order that doesn't exist yet.
ABSENT = 0
#: Status, action and the status that follows. A payment that is notified after a cancellation still counts.
LEGAL = (
    (ABSENT, "submit", 101),
    (101, "cancel", 102), (101, "auto_cancel", 103),
    (101, "pay", 201), (102, "pay", 201), (103, "pay", 201),
    (101, "pay_offline", 201),
    (201, "refund", 202), (202, "refund_confirm", 203),
    (201, "ship", 301),
    (301, "confirm", 401), (301, "auto_confirm", 402),
    (401, "comment", 401), (402, "comment", 402),
)
#: Accepted actions that take goods and use a coupon, and those that bring both back.
TAKES, RETURNS = ("submit",), ("cancel", "auto_cancel", "refund_confirm")

_OUT = "block int, key {key}, at {at}, id {id}, action string, before int, after int, accepted boolean"


class _Machine:
    """A table of moves as arrays over numbered states; a state that the table lacks has no legal move."""

    def __init__(self, legal: tuple[tuple[int, str, int], ...]) -> None:
        self.states = sorted({s for a, _, b in legal for s in (a, b)})
        at = {s: i for i, s in enumerate(self.states)}
        self.next = {action: {a: b for a, x, b in legal if x == action} for _, action, _ in legal}
        same = np.arange(len(self.states))
        self.maps = {}
        for action, steps in self.next.items():
            m = same.copy()
            for a, b in steps.items():
                m[at[a]] = at[b]
            self.maps[action] = m
        self.same = same

    def fold(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by block, key and order, of whole blocks: the states before and after each."""
        current, state = None, None
        for b in batches:
            before, after = [], []
            for block, key, start, action in zip(b["block"], b["key"], b["start"], b["action"], strict=True):
                if (block, key) != current:
                    current, state = (block, key), start
                before.append(state)
                state = self.next.get(action, {}).get(state, state)
                after.append(state)
            accepted = [x in self.next.get(a, ()) for a, x in zip(b["action"], before, strict=True)]
            yield b.drop(columns="start").assign(before=np.array(before, "int32"), after=np.array(after, "int32"), accepted=np.array(accepted, bool))

    def compose(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The same rows, of which each run of one block and key becomes one map from any state to the state after it."""
        current, whole, start = None, None, None
        for b in batches:
            out = []
            for block, key, first, action in zip(b["block"], b["key"], b["start"], b["action"], strict=True):
                if (block, key) != current:
                    if current:
                        out.append((*current, start, whole.tolist()))
                    current, whole, start = (block, key), self.same, first
                if action in self.maps:
                    whole = self.maps[action][whole]
            yield pd.DataFrame(out, columns=["block", "key", "start", "map"])
        if current:
            yield pd.DataFrame([(*current, start, whole.tolist())], columns=["block", "key", "start", "map"])

    def starts(self, maps: pd.DataFrame) -> pd.DataFrame:
        """The state in which each block of one key starts. Only the maps of the key's blocks are in memory."""
        maps = maps.sort_values("block")
        state, out = int(maps["start"].iloc[0]), []
        for m in maps["map"]:
            out.append(state)
            if state in self.states:
                state = self.states[m[self.states.index(state)]]
        return maps[["block", "key"]].assign(begins=np.array(out, "int32"))


def moved(orders: DataFrame, moves: DataFrame, folder: str, legal: tuple[tuple[int, str, int], ...] = LEGAL, block_rows: int = 500_000) -> DataFrame:
    """orders (order_id, status), moves (order_id, at, id, action) -> order_id, at, id, action, before, after, accepted: every
    action in order of at (null first), then id, which is unique; one that isn't legal in the state that the earlier ones
    have led to is refused and changes nothing. Orders that aren't listed don't exist yet (state 0). Of several rows of an
    order the greatest status counts. Moves of a null order are refused without states.

    Moves are dealt into blocks of about block_rows by ranges of (order, time, id), so that an order with very many of them
    covers several blocks. Such orders lie at the ends of blocks. Their pieces are first made into maps from state to state,
    which are put one after the other to tell each piece's start; then all blocks are folded at once. Blocks are written
    to the folder, which executors share."""
    spark, machine = moves.sparkSession, _Machine(legal)
    moves = moves.select(F.col("order_id").alias("key"), "at", "id", F.col("action").cast("string").alias("action"))
    status = orders.where("order_id is not null").groupBy(F.col("order_id").alias("key")).agg(F.max("status").cast("int").alias("start"))
    known = moves.where("key is not null")
    blocks = max(1, -(-known.count() // block_rows))
    dealt = known.join(status, "key", "left").withColumn("start", F.coalesce("start", F.lit(ABSENT))).repartitionByRange(blocks, "key", "at", "id")
    dealt.withColumn("block", F.spark_partition_id()).write.parquet(f"{folder}/blocks")
    placed = spark.read.parquet(f"{folder}/blocks").select("block", "key", "at", "id", "action", "start")
    kinds = {f.name: f.dataType.simpleString() for f in moves.schema}
    sorted_blocks = lambda rows: rows.repartition(blocks, "block").sortWithinPartitions("block", "key", "at", "id")
    ends = placed.groupBy("block").agg(F.min("key").alias("a"), F.max("key").alias("b")).select(F.explode(F.array_distinct(F.array("a", "b"))).alias("key"))
    crossing = ends.groupBy("key").count().where("count > 1").select("key")  # at most two keys a block
    maps = sorted_blocks(placed.join(crossing, "key", "left_semi").select(*placed.columns)).mapInPandas(machine.compose, f"block int, key {kinds['key']}, start int, map array<int>")
    maps.groupBy("key").applyInPandas(lambda m: machine.starts(m), f"block int, key {kinds['key']}, begins int").write.parquet(f"{folder}/starts")
    begun = placed.join(spark.read.parquet(f"{folder}/starts"), ["block", "key"], "left").select("block", "key", "at", "id", "action", F.coalesce("begins", "start").alias("start"))
    done = sorted_blocks(begun).mapInPandas(machine.fold, _OUT.format(**kinds)).drop("block")
    nothing = F.lit(None).cast("int")
    lost = moves.where("key is null").select("*", nothing.alias("before"), nothing.alias("after"), F.lit(False).alias("accepted"))
    return done.unionByName(lost).withColumnRenamed("key", "order_id")


def stock_moves(done: DataFrame, lines: DataFrame) -> DataFrame:
    """moved() rows, lines (order_id, goods_id, number) -> goods_id, order_id, at, id, delta of accepted actions: a submission
    takes each line's pieces, a cancellation or confirmed refund brings them back. Ids are those of the moves."""
    effect = F.when(F.col("action").isin(*TAKES), -1).when(F.col("action").isin(*RETURNS), 1)
    felt = done.where("accepted").select("order_id", "at", "id", effect.alias("sign")).where("sign is not null")
    return felt.join(lines.select("order_id", "goods_id", "number"), "order_id").select("goods_id", "order_id", "at", "id", (F.col("sign") * F.col("number")).cast("bigint").alias("delta"))


def coupon_states(done: DataFrame, coupons: DataFrame) -> DataFrame:
    """moved() rows, coupons (coupon_id, order_id) -> coupon_id, order_id, status, times_used: used by an accepted submission,
    usable again after a cancellation or confirmed refund; one whose order did neither is usable."""
    effect = F.when(F.col("action").isin(*TAKES), "used").when(F.col("action").isin(*RETURNS), "usable")
    felt = done.where("accepted").select("order_id", "at", "id", effect.alias("status")).where("status is not null")
    last = felt.groupBy("order_id").agg(F.max_by("status", F.struct("at", "id")).alias("status"), F.count(F.when(F.col("status") == "used", 1)).alias("n"))
    return coupons.select("coupon_id", "order_id").join(last, "order_id", "left").select("coupon_id", "order_id", F.coalesce("status", F.lit("usable")).alias("status"), F.coalesce("n", F.lit(0)).alias("times_used"))

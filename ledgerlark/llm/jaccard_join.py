"""Exact n-gram Jaccard self-join with a token-group matrix.

Documents with equal shingle sets become one representative. Candidates come from a partition of each set: two sets
that reach the threshold differ in few shingles, so of a few more parts than that, cut by hash range, at least one part
holds the same shingles in both. Documents that share enough parts are put into groups of bounded size under the
smallest document that they share most with. A group's token union bounds a query's overlap with all its members; only a
group whose bound reaches the threshold is opened, and then its token matrix gives every overlap at once.

Where components are all that is asked for, groups are first linked inside and with their leaders, which joins a family
of near copies at once. Then only groups that hold different components still ask each other.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import _ODD, _U, buffers, discard, lowered, materialize, mix, shingle_sets
from ledgerlark.llm.components import connected_components
from ledgerlark.session import table

#: Members of a group and queries opened with it in one task; a larger family takes more groups.
GROUP, QUERIES_A_TASK = 256, 1024


@functools.lru_cache
def size_classes(percent: int, most: int) -> np.ndarray:
    """Smallest set size of each class up to the first one over most. A class is wide enough that partners lie in the same or a neighbouring class;
    wide classes save signatures, but leave fewer shingles to a part, so low thresholds have narrow ones."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(int(lows[-1] * (100 / percent) ** (3 if percent >= 90 else 1)) + 1)
    return np.array(lows)


def parts_of(lows: np.ndarray, c: int, percent: int) -> tuple[int, int]:
    """Parts for class c, and how many more there are than differences: partners agree in more than that many, of which
    some may be empty in both."""
    largest = int(lows[c + 1]) - 1
    differ = (100 - percent) * 2 * largest // (100 + percent)
    spare = 1 + -(-differ // 8)
    return differ + 1 + spare, spare


def signatures(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """One hash for each part of a sorted set, in its own size class and in the next where a larger partner may be, and
    the number of them that it shares with every partner at least. Empty parts are left out as long as others suffice."""
    n = len(tokens)
    lows = size_classes(percent, 1 << max(24, 2 * n.bit_length()))  # the two classes above a set's own are in it
    own = int(np.searchsorted(lows, n, "right")) - 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(tokens ^ _ODD[5]))])
    out, need = [], n
    for c in (own, own + 1):
        if c > own and 100 * n < percent * int(lows[c]):
            break
        k, spare = parts_of(lows, c, percent)
        part = ((tokens >> _U(32)) * _U(k)) >> _U(32)
        cuts = np.searchsorted(part, np.arange(k + 1, dtype=np.uint64))
        filled = np.diff(cuts) > 0
        sig = mix((sums[cuts[1:]] - sums[cuts[:-1]]) * _ODD[0] + np.arange(k, dtype=np.uint64) * _ODD[1] + _U((c + 1) * int(_ODD[2]) & 0xFFFFFFFFFFFFFFFF))
        empty = k - int(filled.sum())
        out.append(sig[filled] if empty <= spare else sig)
        need = min(need, max(1, spare + 1 - empty))
    return np.concatenate(out), need


def _printed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each row's set size and two hashes of its set."""
    for batch in batches:
        for lo, hi, buf, offs in buffers(batch.column("text")):
            sets = list(shingle_sets(lowered(buf), offs, k))
            prints = [mix(np.array([s.sum(dtype=np.uint64), mix(s + _U(1)).sum(dtype=np.uint64)], dtype=np.uint64) + _U(len(s))) if len(s) else np.zeros(2, dtype=np.uint64) for s in sets]
            prints = np.array(prints, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            columns = [batch.column(x).slice(lo, hi - lo) for x in ("row", "t")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=["row", "t", "n", "p0", "p1"])


def _parted(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A row for each part of each row's set."""
    for batch in batches:
        for lo, hi, buf, offs in buffers(batch.column("text"), 1 << 19):
            rows = batch.column("row").to_numpy()[lo:hi]
            signed = [signatures(s, percent) for s in shingle_sets(lowered(buf), offs, k)]
            lens = [len(s) for s, _ in signed]
            needs = np.array([n for _, n in signed], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, lens)), pa.array(np.repeat(needs, lens)), pa.array(np.concatenate([s for s, _ in signed]).view(np.int64))], names=["row", "need", "sig"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in buffers(batch.column("text")):
            rest = [batch.column(x).slice(lo, hi - lo) for x in ("row", "weight")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([s.tobytes() for s in shingle_sets(lowered(buf), offs, k)], pa.binary())], names=["row", "weight", "tokens"])


def open_group(members: list[np.ndarray], queries: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, members it links with). A query whose overlap with the token union is too small opens nothing."""
    sizes = np.array([len(m) for m in members])
    union, at = np.unique(np.concatenate(members), return_inverse=True)
    owner = np.repeat(np.arange(len(members)), sizes)[np.argsort(at, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(union)))])
    for i, q in enumerate(queries):
        found = np.minimum(np.searchsorted(union, q), len(union) - 1)
        found = found[union[found] == q]
        if 100 * len(found) < percent * len(q):
            continue
        lens = starts[found + 1] - starts[found]
        take = np.repeat(starts[found] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
        common = np.bincount(owner[take], minlength=len(members))
        linked = np.flatnonzero(100 * common >= percent * (len(q) + sizes - common))
        if len(linked):
            yield i, linked


def _group_links(table_: pa.Table, percent: int, degrees: bool) -> pa.Table:
    """Links of one group with the queries dealt to this task, enough to connect what is linked: (a, b) with the smallest
    member of each subset that is linked so far, fewer than there are rows, and where degrees are asked for (a, null, the
    weight of all that a links with). Roles: 0 member, 1 query, 2 both."""
    row, weight, role = (table_.column(x).to_numpy() for x in ("row", "weight", "role"))
    sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table_.column("tokens")]
    mine, asked = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    links: set[tuple[int, int]] = set()
    degree: dict[int, int] = {}
    if len(mine) and len(asked):
        mine = mine[np.argsort(row[mine])]
        root = list(range(len(mine)))
        ids, heavy = row[mine], weight[mine]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        place = {int(r): i for i, r in enumerate(ids)}
        later = []
        for i, linked in open_group([sets[j] for j in mine], [sets[j] for j in asked], percent):
            q = int(row[asked[i]])
            own = place.get(q)
            others = linked[ids[linked] != q]
            if degrees:
                degree[q] = degree.get(q, 0) + int(heavy[others].sum())
            if own is None:
                for j in others.tolist() if degrees else ():
                    degree[int(ids[j])] = degree.get(int(ids[j]), 0) + int(weight[asked[i]])
                later.append((q, others))
            else:
                for j in others.tolist():
                    a, b = find(own), find(j)
                    root[max(a, b)] = min(a, b)
        links |= {(int(ids[i]), int(ids[find(i)])) for i in range(len(ids)) if find(i) != i}
        for q, others in later:  # what a query links is one subset for the queries after it, so links are fewer than rows
            found = {find(j) for j in others.tolist()}
            links |= {(q, int(ids[x])) for x in found}
            for x in found:
                root[x] = min(found)
    a = [x for x, _ in links] + list(degree)
    b = [y for _, y in links] + [None] * len(degree)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "degree": pa.array([0] * len(links) + list(degree.values()), pa.int64())})


def jaccard_join(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, and n_links where links are asked for.

    Shingles are of k words of the text in which A-Z is lower-cased; with fewer words the whole sequence is one. Two
    rows link when 100 * |intersection| >= percent * |union|; component_id is the smallest id reachable by links,
    n_links the number of rows linked with. Counting links opens every pair of similar groups; components alone need
    none of a family that is linked already. A null or wordless text is linked with nothing. A null id stays a row of
    its own with a null component; rows that repeat an id are rows of one document, of whose texts that of the smallest
    hash is linked with others. Extra columns are ignored, an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("row"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    prints = materialize(base.mapInArrow(lambda it: _printed(it, k), "row long, t long, n long, p0 long, p1 long"), "prints")
    sets = prints.where("n > 0 and row is not null")
    # Grouped by both prints and joined on these and the size: the join deals rows anew, so that a hot group is split.
    classes = sets.groupBy("p0", "p1").agg(F.min("row").alias("rep"), F.count("*").alias("weight"), F.max("n").alias("n"))
    classed = sets.join(classes, ["p0", "p1", "n"]).select("row", "t", "n", "rep", "weight")
    alone = prints.where("n = 0 or row is null").select("row", "t", "n", F.col("row").alias("rep"), F.lit(0).cast("bigint").alias("weight"))
    classed = materialize(classed.unionByName(alone), "classed")
    discard(prints)
    reps = classed.where("row = rep and weight > 0").groupBy("row").agg(F.min("t").alias("t"), F.max("weight").alias("weight"))

    # Merged at every size: whether the few ids could be broadcast must not decide how much is moved.
    mine = base.join(reps.select("row", "t").hint("merge"), ["row", "t"]).dropDuplicates(["row", "t"])
    parts = materialize(mine.mapInArrow(lambda it: _parted(it, k, percent), "row long, need int, sig long"), "parts")
    # Counted first, so that a part that many hold is summed before it is moved, and joined back, which can be split.
    often = parts.groupBy("sig").agg(F.min("row").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    often = materialize(often, "often")
    live = materialize(parts.join(often, "sig"), "live")
    discard(parts, often)
    dealt = materialize(_cells(live).join(reps, "row"), "dealt")
    held = base.join(dealt.select("row", "t", "weight").hint("merge"), ["row", "t"]).dropDuplicates(["row", "t"])
    held = materialize(held.mapInArrow(lambda it: _sets(it, k), "row long, weight long, tokens binary"), "sets")

    degrees = None
    if links:
        found = _opened(held, dealt.select("row", "cell", "chunk"), _all_asks(live, dealt), percent, True)
        degrees = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("degree").alias("degree"))
        comps = connected_components(found.where("b is not null").select("a", "b"))
    else:
        own = dealt.select("row", "cell", "chunk")
        leaders = dealt.groupBy("leader", "cell", "chunk").count().select(F.col("leader").alias("row"), F.col("cell").alias("to_cell"), F.col("chunk").alias("to_chunk"))
        leaders = materialize(leaders.join(own, "row").where("cell <> to_cell or chunk <> to_chunk").select("row", "to_cell", "to_chunk"), "asks")
        first = _opened(held, own, leaders, percent, False)
        comps = materialize(connected_components(first.select("a", "b")), "comps")
        own, asks = _left_asks(live, dealt, comps)
        second = _opened(held, own, asks, percent, False, F.lit(False))
        comps = connected_components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(second.select("a", "b")))
    out = classed.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    columns = [F.col("row").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")]
    if degrees is not None:
        out = out.join(degrees, "rep", "left")
        columns.append(F.greatest(F.lit(0), F.col("weight") - 1 + F.coalesce("degree", F.lit(0))).cast("bigint").alias("n_links"))
    return out.select(columns)


def _cells(live: DataFrame) -> DataFrame:
    """(row, need, sig, leader) -> row, need, leader, cell, chunk of the rows that may have partners.

    A partner shares at least `need` parts. Documents with fewer shared parts have none; the others follow the smallest
    document with which they share most parts, or start a cell. Cells whose leaders follow each other become one. A
    cell's followers of one leader are kept together in groups as far as these hold them.
    """
    shared = live.groupBy("row", "need", "leader").agg(F.count("*").alias("n"))
    close = F.when(F.col("leader") < F.col("row"), F.struct("n", -F.col("leader")))
    cells = shared.groupBy("row", "need").agg(F.sum("n").alias("n"), F.coalesce(F.max_by("leader", close), F.col("row")).alias("leader")).where("n >= need").drop("n")
    cells = materialize(cells, "cells")
    up = cells.select(F.col("leader").alias("head")).distinct().join(cells.select(F.col("row").alias("head"), F.col("leader").alias("up")), "head", "left").select("head", F.coalesce("up", "head").alias("up"))
    for _ in range(2):  # each step doubles how far up a head looks
        up = materialize(up, "heads")
        up = up.join(up.select(F.col("head").alias("up"), F.col("up").alias("upper")), "up", "left").select("head", F.coalesce("upper", "up").alias("up"))
    cells = cells.join(up.select(F.col("head").alias("leader"), F.col("up").alias("cell")), "leader")
    followers = cells.groupBy("cell", "leader").agg(F.count("*").alias("held"))
    small = followers.groupBy("cell").agg(F.expr(f"cast(ceil(coalesce(sum(case when held <= {GROUP} then held end), 0) / {GROUP}) as bigint)").alias("packs"))
    followers = followers.join(small, "cell").select("leader", "held", "packs")  # a leader is in one cell
    chunk = f"case when held > {GROUP} then xxhash64(leader, pmod(xxhash64(row), cast(ceil(held / {GROUP}) as bigint))) else pmod(xxhash64(leader), packs) end"
    return cells.join(followers, "leader").select("row", "need", "leader", "cell", F.expr(chunk).alias("chunk"))


def _all_asks(live: DataFrame, dealt: DataFrame) -> DataFrame:
    """Rows and the earlier groups to ask: groups that share enough parts for one member to have a partner in the other."""
    placed = live.select("row", "sig").join(dealt.select("row", "cell", "chunk", "need"), "row").groupBy("sig", "cell", "chunk").agg(F.min("need").alias("need"))
    others = placed.select("sig", F.col("cell").alias("to_cell"), F.col("chunk").alias("to_chunk"))
    pairs = placed.join(others, "sig").where("struct(to_cell, to_chunk) < struct(cell, chunk)")
    pairs = pairs.groupBy("cell", "chunk", "to_cell", "to_chunk").agg(F.count("*").alias("shared"), F.min("need").alias("need")).where("shared >= need")
    return materialize(pairs.join(dealt.select("row", "cell", "chunk"), ["cell", "chunk"]).select("row", "to_cell", "to_chunk"), "asks")


def _left_asks(live: DataFrame, dealt: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups, each cut in two, and the rows and groups to ask, for links between different components.

    The rows of a cell's most frequent component are cut from the others of their group. In each part's bucket the
    component of the largest group is left out of the asking side, so a linked family never meets itself.
    """
    known = dealt.join(comps.select(F.col("id").alias("row"), "component"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    main = known.groupBy("cell", "component").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    cut = F.shiftleft("chunk", 1).bitwiseOR((F.col("component") != F.col("main")).cast("bigint"))
    known = materialize(known.join(main, "cell").select("row", "need", "component", "cell", F.col("chunk").alias("met"), cut.alias("chunk")), "known")
    placed = live.select("row", "sig").join(known, "row").groupBy("sig", "cell", "met", "chunk")
    placed = placed.agg(F.min("need").alias("need"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("sig").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.max_by("low", F.struct(F.when(F.col("low") == F.col("high"), F.col("rows")).otherwise(0), "low")).alias("top"))
    placed = materialize(placed.join(mixed.where("least < most").select("sig", "top"), "sig").withColumn("is_top", F.expr("low = top and high = top")), "mixed")
    to = placed.select("sig", *(F.col(x).alias(f"to_{x}") for x in ("cell", "met", "chunk", "low", "high", "is_top")))
    # Rows of one group have met already.
    pairs = placed.where("not is_top").join(to, "sig").where("(to_is_top or struct(to_cell, to_chunk) < struct(cell, chunk)) and (to_cell <> cell or to_met <> met) and not (low = high and to_low = low and to_high = low)")
    pairs = pairs.groupBy("cell", "chunk", "to_cell", "to_chunk").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    # A pair may have met in both directions, by bucket: asked once, by the later group.
    turned = F.expr("struct(cell, chunk) < struct(to_cell, to_chunk)")
    pairs = pairs.select(*(F.when(turned, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("to_cell", "cell"), ("to_chunk", "chunk"), ("cell", "to_cell"), ("chunk", "to_chunk"))), "shared", "need")
    pairs = pairs.groupBy("cell", "chunk", "to_cell", "to_chunk").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need")
    asks = materialize(pairs.join(known.select("row", "cell", "chunk"), ["cell", "chunk"]).select("row", "to_cell", "to_chunk"), "asks")
    return known.select("row", "cell", "chunk"), asks


def _opened(held: DataFrame, own: DataFrame, asks: DataFrame, percent: int, degrees: bool, inside: Column | None = None) -> DataFrame:
    """Links (a, b) of groups with what asks them, and between the members of a group where inside holds (always, if not
    given): held (row, weight, tokens), own (row, cell, chunk), asks (row, to_cell, to_chunk)."""
    slots = asks.groupBy("to_cell", "to_chunk").agg(F.expr(f"cast(ceil(count(*) / {QUERIES_A_TASK}) as bigint)").alias("slots"))
    slots = materialize(slots.select(F.col("to_cell").alias("cell"), F.col("to_chunk").alias("chunk"), "slots"), "slots")
    queries = asks.select("row", F.col("to_cell").alias("cell"), F.col("to_chunk").alias("chunk")).join(slots, ["cell", "chunk"])
    queries = queries.select("row", "cell", "chunk", F.expr("pmod(xxhash64(row, 7), slots)").alias("slot"), F.lit(1).alias("role"))
    inside = F.lit(True) if inside is None else inside
    spread = own.join(slots, ["cell", "chunk"], "left").where(F.col("slots").isNotNull() | inside).withColumn("slot", F.explode(F.expr("sequence(0L, coalesce(slots, 1L) - 1)")))
    spread = spread.select("row", "cell", "chunk", "slot", F.when((F.col("slot") == 0) & inside, 2).otherwise(0).alias("role"))
    # One join brings the tokens to members and queries alike.
    rows = spread.unionByName(queries).join(held, "row").select("cell", "chunk", "slot", "row", "weight", "role", "tokens")
    found = rows.groupBy("cell", "chunk", "slot").applyInArrow(lambda t: _group_links(t, percent, degrees), "a long, b long, degree long")
    return materialize(found, "found")


def op3_token_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op3_token_group_jaccard": op3_token_group_jaccard}

ORACLE_SQL = {
    "op3_token_group_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]) END) AS sh FROM w
        ), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS tok FROM s
        ), c AS (
            SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS x
            FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2
        ), l AS (SELECT a, b FROM c WHERE 100 * x >= 90 * (na + nb - x)
        ), r(id, root) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a
        )
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, q.root AS component_id FROM s JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) q ON q.id = s.doc_id
    """,
}

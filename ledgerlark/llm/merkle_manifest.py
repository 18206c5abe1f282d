"""Merkle manifest of a dataset as a persistent tree: a changed row makes a version that copies its ancestors and shares the rest.

Rows of a group are leaves in the order of their ids; every 8 consecutive nodes have one above them. The tree is built in
aligned blocks of 512 nodes, each by one small task, block by block upwards; the groups' subroots are the leaves of a last
tree. Then paths come down: a block gets the siblings above it once, and from these every leaf has its proof and every
changed leaf its version, a copied node a level, first inside the block and on through the levels that other tasks built.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import discard, materialize, numbered
from ledgerlark.session import table

#: Nodes under one, and levels that a task builds: blocks of FAN ** LEVELS aligned nodes.
FAN, LEVELS = 8, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "key string, height int, level int, idx long, digest string"
_PATH = "key string, pos long, before array<string>, after array<string>, subroot string, root string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 of the values: `-` for a null, else the UTF-8 bytes' number, `:` and the value."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def block_levels(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block by level, its own first."""
    out = [digests]
    for _ in range(levels):
        out.append([_hash("".join(out[-1][i : i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def _sorted(t: pa.Table) -> tuple[list[int], list[str]]:
    t = t.sort_by("idx")
    return t.column("idx").to_pylist(), t.column("digest").to_pylist()


def _builder(base: int) -> Callable[[pa.Table], pa.Table]:
    return lambda t: _built(t, base)


def _pather(base: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda t, above: _paths(t, above, base)


def _built(t: pa.Table, base: int) -> pa.Table:
    """The nodes above those of one block, as far as the block goes."""
    idx, digests = _sorted(t)
    key, height = t.column("key")[0].as_py(), t.column("height")[0].as_py()
    levels = block_levels(digests, min(LEVELS, height - base))
    rows = [(base + k, (idx[0] >> 3 * k) + i, d) for k, nodes in enumerate(levels) if k for i, d in enumerate(nodes)]
    return pa.table({"key": pa.array([key] * len(rows), pa.string()), "height": pa.array([height] * len(rows), pa.int32()), "level": pa.array([r[0] for r in rows], pa.int32()), "idx": pa.array([r[1] for r in rows], pa.int64()), "digest": pa.array([r[2] for r in rows], pa.string())})


def _siblings(levels: list[list[str]], i: int) -> Iterator[tuple[str, str]]:
    """What stands before and after node i of a block and before and after its ancestors in their runs."""
    for nodes in levels[:-1]:
        lo = i - i % FAN
        yield "".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + FAN])
        i //= FAN


def _paths(t: pa.Table, above: pa.Table, base: int) -> pa.Table:
    """Each node's siblings up to the root."""
    idx, digests = _sorted(t)
    up = above.to_pylist()[0]
    levels = block_levels(digests, max(0, min(LEVELS, t.column("height")[0].as_py() - base)))
    own = [list(_siblings(levels, i)) for i in range(len(idx))]
    n = len(idx)
    return pa.table({
        "key": pa.array([up["key"]] * n, pa.string()), "pos": pa.array(idx, pa.int64()),
        "before": pa.array([[b for b, _ in x] + up["before"] for x in own], pa.list_(pa.string())), "after": pa.array([[a for _, a in x] + up["after"] for x in own], pa.list_(pa.string())),
        "subroot": pa.array([up["subroot"]] * n, pa.string()), "root": pa.array([up["root"]] * n, pa.string()),
    })


def _proved(t: pa.Table, above: pa.Table) -> pa.Table:
    """Each leaf's proof, the copied nodes of its version if it changed, and the root that this gives."""
    t = t.sort_by("pos")
    digests, changed = t.column("digest").to_pylist(), t.column("changed").to_pylist()
    up = above.to_pylist()[0]
    higher = list(zip(up["before"], up["after"], strict=True))
    rest = "".join(b + a for b, a in higher)
    levels = block_levels(digests, max(0, min(LEVELS, t.column("height")[0].as_py())))
    proofs, copies, folded = [], [], []
    for i, new in enumerate(changed):
        own = list(_siblings(levels, i))
        proofs.append(_hash("".join(b + a for b, a in own) + rest))
        if new is None:
            copies.append(None)
            folded.append(up["root"])
            continue
        nodes = [new]
        for before, after in (*own, *higher):
            nodes.append(_hash(before + nodes[-1] + after))
        copies.append(nodes)
        folded.append(nodes[-1])
    # An unchanged leaf's own siblings give the root as well: it is what they were taken from.
    n = len(digests)
    return pa.table({
        "key": t.column("key"), "pos": t.column("pos"), "id": t.column("id"), "leaf": t.column("digest"), "subroot": pa.array([up["subroot"]] * n, pa.string()), "root": pa.array([up["root"]] * n, pa.string()),
        "proof_sha256": pa.array(proofs, pa.string()), "copied": pa.array(copies, pa.list_(pa.string())), "folded_root": pa.array(folded, pa.string()),
    })


@dataclasses.dataclass(frozen=True)
class Manifest:
    """nodes: key, height, level, idx, digest of the first version; key null for the tree over the subroots, whose leaves
    are the subroots. rows: key, pos, id, leaf, subroot, root, proof_sha256, copied, folded_root a document; copied are the
    nodes of the version that its change makes, from the leaf up through its group's tree to the root."""

    nodes: DataFrame
    rows: DataFrame

    def version(self, id_value: int) -> DataFrame:
        """key, level, idx, digest of the group's whole tree as the change of one document leaves it: copied nodes where
        they are on its way up, shared ones elsewhere."""
        one = self.rows.where((F.col("id") == id_value) & F.col("copied").isNotNull()).select("key", "pos", "copied").limit(1)
        shared = self.nodes.join(one, "key")
        here = F.col("idx") == F.expr("shiftright(pos, 3 * level)")
        return shared.select("key", "level", "idx", F.when(here, F.expr("copied[level]")).otherwise(F.col("digest")).alias("digest"))


def _block(column: str) -> Column:
    return F.shiftright(column, 3 * LEVELS).alias("block")


def _built_up(leaves: DataFrame) -> list[DataFrame]:
    """(key, height, level 0, idx, digest) -> these, and for each layer of blocks the nodes that it adds."""
    layers, base = [leaves], 0
    tallest = leaves.agg(F.max("height")).first()[0] or 0
    while base < tallest:
        foot = layers[-1].where((F.col("level") == base) & (F.col("height") > base))
        made = foot.groupBy("key", _block("idx")).applyInArrow(_builder(base), _STEP)
        layers.append(materialize(made, "nodes"))
        base += LEVELS
    return layers


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _come_down(layers: list[DataFrame], tops: DataFrame, lowest: int) -> DataFrame:
    """Paths of the nodes from which the blocks of layer `lowest` hang, and of the trees that end in that layer; tops
    (height and the columns of a path) has the roots' paths."""
    paths = None
    for k in range(len(layers) - 1, lowest - 1, -1):
        base = k * LEVELS
        ending = tops.where(F.col("height").between(base, base + LEVELS - 1)).drop("height")
        above = ending if paths is None else paths.unionByName(ending)
        if k == lowest:
            return above
        foot = layers[k].where((F.col("level") == base) & (F.col("height") >= base))
        lower = foot.groupBy("key", _block("idx")).cogroup(above.groupBy("key", F.col("pos").alias("block")))
        paths = materialize(lower.applyInArrow(_pather(base), _PATH), "paths")


def _height(n: Column) -> Column:
    """Levels above n leaves: the octal digits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, 8))).cast("int")


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", changed: dict[str, Column] | None = None, when: Column | None = None) -> Manifest:
    """The manifest of docs over `columns`, and a version for each row for which `when` holds, in which `changed` replaces
    columns of that row alone.

    Nulls have a digest of their own; a null group is the first group, null ids stand first in their group, and rows of
    equal id stand in the order of their digests, so repeated rows are leaves side by side. Whole texts are hashed by
    Spark and don't reach a Python task. Other columns are ignored. An empty table has no rows and no nodes.
    """
    changed, when = changed or {}, F.lit(False) if when is None else when
    now = leaf_digest([F.col(c) for c in columns])
    new = leaf_digest([changed.get(c, F.col(c)) for c in columns])
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("key"), F.col(id_col).alias("id"), now.alias("digest"), F.when(when, new).alias("changed"))
    leaves = materialize(leaves, "leaves")
    placed = numbered(leaves, "key", ["id", "digest"], "placed")
    discard(leaves)
    placed = placed.withColumn("height", _height(F.col("key_rows")))
    layers = _built_up(placed.select("key", "height", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest"))

    tops = _all([x.where("level = height") for x in layers]).select(F.lit("").alias("all"), F.col("key").alias("group"), "height", "digest")
    tops = numbered(tops, "all", ["group"], "subroots")
    subroots = tops.select(F.col("all").alias("key"), _height(F.col("key_rows")).alias("height"), F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest")
    above = _built_up(subroots)
    root = _all([x.where("level = height") for x in above])
    nothing = F.array().cast("array<string>")
    root = root.select("key", "height", F.lit(0).cast("bigint").alias("pos"), nothing.alias("before"), nothing.alias("after"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    ways = subroots.groupBy("key", _block("idx")).cogroup(_come_down(above, root, 0).groupBy("key", F.col("pos").alias("block")))
    ways = ways.applyInArrow(_pather(0), _PATH).select("pos", "before", "after", "root")
    ways = tops.join(ways, "pos").select(F.col("group").alias("key"), "height", F.lit(0).cast("bigint").alias("pos"), "before", "after", F.col("digest").alias("subroot"), "root")
    ways = materialize(ways, "ways")

    blocks = placed.select("key", "height", "pos", "id", "digest", "changed").groupBy("key", _block("pos"))
    rows = blocks.cogroup(_come_down(layers, ways, 0).groupBy("key", F.col("pos").alias("block"))).applyInArrow(_proved, f"key string, pos long, id {docs.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, copied array<string>, folded_root string")
    nodes = _all([*layers, *(x.withColumn("key", F.lit(None).cast("string")) for x in above)])
    return Manifest(nodes, rows)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", _UPPER, _LOWER)
    rows = manifest(table(spark, sf_dir, "documents"), changed={"text": lowered}, when=F.crc32(F.col("doc_id").cast("string")) % 3 == 0).rows
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}

ORACLE_SQL = {
    "op11_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, crc.c % 3 = 0 AS hit, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, text,
                   CASE WHEN doc_id IS NULL THEN '-' ELSE len(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END
                   || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE len(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head
            FROM documents, LATERAL (SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS c) AS crc
        ), f AS (
            SELECT doc_id, lang, coalesce('=' || lang, '') AS key, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
                   CASE WHEN hit THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(low)) || ':' || low END) END AS changed FROM d
        ), l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM f
        ), t(key, k, pos, h) AS (
            SELECT key, 0, pos, leaf FROM l
            UNION ALL
            SELECT key, k + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY key) AS c FROM t) WHERE c > 1 GROUP BY key, k, pos // 8
        ), s AS (SELECT key, max(k) AS k, arg_max(h, k) AS h, row_number() OVER (ORDER BY key) - 1 AS pos FROM t GROUP BY key
        ), u(k, pos, h) AS (
            SELECT 0, pos, h FROM s
            UNION ALL
            SELECT k + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY k, pos // 8
        ), top AS (SELECT max(k) AS k, arg_max(h, k) AS root FROM u
        ), way AS (
            SELECT l.doc_id, l.key, l.pos, t.k AS step, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < l.pos >> (3 * t.k)), '') AS before, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > l.pos >> (3 * t.k)), '') AS after
            FROM l JOIN s ON s.key = l.key JOIN t ON t.key = l.key AND t.k < s.k AND t.pos >> 3 = l.pos >> (3 * t.k + 3) GROUP BY ALL
            UNION ALL
            SELECT l.doc_id, l.key, l.pos, s.k + u.k, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < s.pos >> (3 * u.k)), ''), coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > s.pos >> (3 * u.k)), '')
            FROM l JOIN s ON s.key = l.key JOIN u ON u.pos >> 3 = s.pos >> (3 * u.k + 3) JOIN top ON u.k < top.k GROUP BY l.doc_id, l.key, l.pos, s.k, u.k
        ), proofs AS (SELECT key, pos, sha256(string_agg(before || after, '' ORDER BY step)) AS p, count(*) AS n FROM way GROUP BY key, pos
        ), fold(key, pos, step, h) AS (
            SELECT key, pos, 0, coalesce(changed, leaf) FROM l
            UNION ALL
            SELECT key, pos, fold.step + 1, sha256(before || h || after) FROM fold JOIN way USING (key, pos) WHERE way.step = fold.step
        )
        SELECT l.doc_id, l.leaf, s.h AS subroot, root, coalesce(p, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
        FROM l JOIN s ON s.key = l.key CROSS JOIN top LEFT JOIN proofs ON proofs.key = l.key AND proofs.pos = l.pos JOIN fold ON fold.key = l.key AND fold.pos = l.pos AND fold.step = coalesce(n, 0)
    """,
}

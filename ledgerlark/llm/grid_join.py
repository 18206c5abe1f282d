"""Exact cosine self-join of vectors by epsilon grid order.

Unit vectors with a cosine of at least t lie within e = sqrt(2 - 2t) of each other. Vectors are put into cells of side e
along their leading principal dimensions and sorted by cell, so that near vectors are near in the sequence. Intervals of
the sequence form a tree of 16 children each with the box of what they hold; pairs of intervals are opened from the root
down and left out when their boxes lie more than e apart. The pairs of tiles that remain are tasks, in which the same
recursion goes on by halves: distant halves are skipped, halves that lie wholly within e are counted without products,
and the rest are multiplied in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.llm.common import discard, materialize, numbered
from ledgerlark.llm.components import connected_components
from ledgerlark.session import table

#: Rows of a tile, rows of the smallest interval inside a task, children of an interval.
TILE, LEAF, FAN = 4096, 128, 16
#: Leading principal dimensions of the grid, and vectors of the bounded sample that they are fitted on.
GRID_DIMS, SAMPLE = 6, 2048
#: Room for rounding where a bound decides: nothing that near to the threshold is skipped or counted unseen.
SLACK = 1e-9


def usable(vec: Column) -> Column:
    """True for vectors with components, all of them finite numbers, not all zero."""
    real = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vec) > 0) & real & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _rows(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the rows of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.asarray(column.value_lengths())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lens)])
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        yield at, flat[starts[at][:, None] + np.arange(n)]


def principal(classes: DataFrame, dims: int = GRID_DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions of a sample of at most SAMPLE vectors, those of the smallest hashes among the
    ones of the most frequent length in it. Any directions give right results; these skip most."""
    n = classes.count()
    drawn = F.xxhash64("vec", F.lit(3))
    some = classes.where(F.pmod(drawn, F.lit(max(1, n // (4 * SAMPLE)))) == 0).orderBy(drawn, "cls").limit(SAMPLE).select("vec").toArrow()
    if not some.num_rows:
        return np.zeros(1), np.zeros((1, 1))
    _, vectors = max(_rows(some.column("vec")), key=lambda x: len(x[0]))
    vectors = unit(vectors)
    mean = vectors.mean(axis=0)
    _, _, directions = np.linalg.svd(vectors - mean, full_matrices=False)
    return mean, directions[:dims].T


def projected(vectors: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Leading coordinates. Vectors of another length are cut or filled with zeros, which brings none further apart."""
    n = min(vectors.shape[1], len(mean))
    return vectors[:, :n] @ directions[:n] - mean @ directions


def _celled(batches: Iterator[pa.RecordBatch], mean: np.ndarray, directions: np.ndarray, side: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spots = np.zeros((batch.num_rows, directions.shape[1]))
        for at, vectors in _rows(batch.column("vec")):
            spots[at] = projected(unit(vectors), mean, directions)
        cells = np.floor(spots / side).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "rep", "weight", "vec")), *(pa.array(cells[:, i]) for i in range(cells.shape[1])), pa.array(spots[:, 0])], names=["cls", "rep", "weight", "vec", *(f"c{i}" for i in range(cells.shape[1])), "first"])


def _tiled(t: pa.Table, mean: np.ndarray, directions: np.ndarray, rows: int) -> pa.Table:
    """One row for a tile, with the box of its leading coordinates."""
    t = t.sort_by("pos")
    spots = np.concatenate([projected(unit(v), mean, directions) for _, v in _rows(t.column("vec"))])
    box = {f"{side}{i}": pa.array([float(x)]) for side, f in (("lo", np.min), ("hi", np.max)) for i, x in enumerate(f(spots, axis=0))}
    packed = {c: pa.array([t.column(c).to_pylist()], pa.list_(t.column(c).type)) for c in ("cls", "weight", "vec")}
    return pa.table({"tile": pa.array([t.column("pos")[0].as_py() // rows], pa.int64()), **packed, **box})


class _Tile:
    """Unit vectors of one tile in sequence order, with boxes and balls of its intervals."""

    def __init__(self, cls: np.ndarray, weight: np.ndarray, vectors: np.ndarray, mean: np.ndarray, directions: np.ndarray):
        self.cls, self.weight, self.unit = cls, weight, unit(vectors)
        self.spots = projected(self.unit, mean, directions)
        self._held: dict[tuple[int, int], tuple] = {}

    def held(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        if (lo, hi) not in self._held:
            part = self.unit[lo:hi]
            middle = part.mean(axis=0)
            radius = float(np.sqrt(((part - middle) ** 2).sum(axis=1).max()))
            self._held[lo, hi] = self.spots[lo:hi].min(axis=0), self.spots[lo:hi].max(axis=0), middle, radius
        return self._held[lo, hi]


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the rows and columns of a matrix of links: equal where they are linked; -1 for those without a link."""
    n, m = near.shape
    high = n + m
    rows = np.where(near.any(axis=1), np.arange(n), high)
    while True:
        cols = np.where(near, rows[:, None], high).min(axis=0)
        new = np.where(near, cols[None, :], high).min(axis=1)
        new = np.minimum(new, rows)
        if (new == rows).all():
            return np.where(rows < high, rows, -1), np.where(cols < high, cols, -1)
        rows = new


def join_tiles(a: _Tile, b: _Tile, least: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights linked with each row of a and of b, and links (place, place) that join what is linked; places of b come
    after those of a. A tile joined with itself counts each pair once for either row."""
    same, n = a is b, len(a.cls)
    reach = np.sqrt(2 - 2 * least)
    counts = np.zeros(n), np.zeros(len(b.cls))
    links: set[tuple[int, int]] = set()
    shift = 0 if same else n
    todo = [(0, n, 0, len(b.cls))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if same and j1 <= i0:
            continue
        lo_a, hi_a, mid_a, rad_a = a.held(i0, i1)
        lo_b, hi_b, mid_b, rad_b = b.held(j0, j1)
        gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
        between = float(np.sqrt(((mid_a - mid_b) ** 2).sum()))
        if np.sqrt((gap * gap).sum()) > reach + SLACK or between - rad_a - rad_b > reach + SLACK:
            continue
        own = same and i0 == j0 and i1 == j1
        if between + rad_a + rad_b < reach - SLACK and (own or not same or j0 >= i1):
            counts[0][i0:i1] += b.weight[j0:j1].sum() - (a.weight[i0:i1] if own else 0)
            if not own:
                counts[1][j0:j1] += a.weight[i0:i1].sum()
            links.update((i0, j + shift) for j in range(j0, j1))
            links.update((i, j0 + shift) for i in range(i0, i1))
        elif max(i1 - i0, j1 - j0) <= leaf:
            near = a.unit[i0:i1] @ b.unit[j0:j1].T >= least
            if own:
                np.fill_diagonal(near, False)
            if near.any():
                counts[0][i0:i1] += near @ b.weight[j0:j1]
                if not own:
                    counts[1][j0:j1] += a.weight[i0:i1] @ near
                rows, cols = _forest(near)
                links.update((i0 + int(x), i0 + i) for i, x in enumerate(rows.tolist()) if x >= 0)
                links.update((i0 + int(x), j0 + j + shift) for j, x in enumerate(cols.tolist()) if x >= 0)
        else:
            i, j = (i0 + i1) // 2, (j0 + j1) // 2
            cut_a = [(i0, i), (i, i1)] if i1 - i0 > leaf else [(i0, i1)]
            cut_b = [(j0, j), (j, j1)] if j1 - j0 > leaf else [(j0, j1)]
            todo += [(*x, *y) for x in cut_a for y in cut_b if not (same and y[1] <= x[0])]
    if same:
        counts = counts[0] + counts[1], counts[1]
    return *counts, sorted((x, y) for x, y in links if x != y)


def _opened(t: pa.Table, mean: np.ndarray, directions: np.ndarray, least: float, leaf: int) -> pa.Table:
    """Of a pair of tiles: (a, null, linked weight) for each vector with links, and links (a, b, 0) that join them."""
    sides = []
    for k in range(t.num_rows):
        vec = t.column("vec")[k].values
        cls, weight = (t.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("cls", "weight"))
        sides.append({v.shape[1]: _Tile(cls[at], weight[at].astype(np.float64), v, mean, directions) for at, v in _rows(vec)})
    a, b, degree = [], [], []
    for n in sides[0]:
        if n not in sides[-1]:
            continue
        one, two = sides[0][n], sides[-1][n]
        left, right, links = join_tiles(one, two, least, leaf)
        counted = [(one, left)] if one is two else [(one, left), (two, right)]
        for tile, counts in counted:
            some = np.flatnonzero(counts)
            a += tile.cls[some].tolist()
            b += [None] * len(some)
            degree += counts[some].astype(np.int64).tolist()
        names = one.cls if one is two else np.concatenate([one.cls, two.cls])
        for x, y in _joined(links, len(names)):
            a.append(int(names[x]))
            b.append(int(names[y]))
            degree.append(0)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "degree": pa.array(degree, pa.int64())})


def _joined(links: list[tuple[int, int]], n: int) -> Iterator[tuple[int, int]]:
    """Each linked place with the smallest of its component."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in links:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return ((find(i), i) for i in range(n) if find(i) != i)


def _near_tiles(tiles: DataFrame, dims: int, reach: float) -> DataFrame:
    """Pairs x <= y of tiles whose boxes lie within reach, found from the root of the interval tree down."""
    sides = [f"{s}{i}" for s in ("lo", "hi") for i in range(dims)]
    levels = [materialize(tiles.select(F.col("tile").alias("node"), *sides), "boxes")]
    most = levels[0].agg(F.max("node")).first()[0] or 0
    while most:
        most //= FAN
        up = levels[-1].groupBy(F.expr(f"node div {FAN}").alias("node"))
        levels.append(up.agg(*(getattr(F, "min" if s[:2] == "lo" else "max")(s).alias(s) for s in sides)))
    pairs = levels[-1].select(F.col("node").alias("x"), F.col("node").alias("y"))
    for below in levels[-2::-1]:
        child = below.withColumn("up", F.expr(f"node div {FAN}"))
        one = child.select(F.col("up").alias("x"), F.col("node").alias("nx"), *(F.col(s).alias(f"x_{s}") for s in sides))
        two = child.select(F.col("up").alias("y"), F.col("node").alias("ny"), *(F.col(s).alias(f"y_{s}") for s in sides))
        gaps = [F.greatest(F.lit(0.0), F.col(f"x_lo{i}") - F.col(f"y_hi{i}"), F.col(f"y_lo{i}") - F.col(f"x_hi{i}")) for i in range(dims)]
        apart = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
        pairs = pairs.join(one, "x").join(two, "y").where((F.col("nx") <= F.col("ny")) & (apart <= (reach + SLACK) ** 2)).select(F.col("nx").alias("x"), F.col("ny").alias("y"))
    return materialize(pairs, "pairs")


def grid_join(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Rows link when the cosine of their vectors, in double precision, is at least `least` (over 0, under 1). Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of different lengths,
    and rows with a null id, whose component is null and which are not kept. Rows that repeat an id are vectors of
    their own, linked like others; kept then holds for each row whose id is its component's. Equal vectors are one
    class, of which one is compared. Other columns are ignored; an empty table gives an empty result.
    """
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    good = usable(F.col("vec")) & F.col("id").isNotNull()
    classes = base.where(good).groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    mean, directions = principal(classes)
    dims, reach = directions.shape[1], float(np.sqrt(2 - 2 * least))
    tile_rows, leaf = TILE, LEAF

    cells = ", ".join(f"c{i} int" for i in range(dims))
    kind = base.schema["vec"].dataType.simpleString()
    celled = classes.mapInArrow(lambda it: _celled(it, mean, directions, reach), f"cls long, rep long, weight long, vec {kind}, {cells}, first double").withColumn("all", F.lit(0))
    placed = numbered(celled.drop("rep"), "all", [*(f"c{i}" for i in range(dims)), "first"], "sequence")
    boxes = [T.StructField(f"{s}{i}", T.DoubleType()) for s in ("lo", "hi") for i in range(dims)]
    packed = [T.StructField(c, T.ArrayType(placed.schema[c].dataType)) for c in ("cls", "weight", "vec")]
    tiles = placed.groupBy(F.expr(f"pos div {tile_rows}").alias("t")).applyInArrow(lambda t: _tiled(t, mean, directions, tile_rows), T.StructType([T.StructField("tile", T.LongType()), *packed, *boxes]))
    tiles = materialize(tiles, "tiles")
    discard(placed)

    pairs = _near_tiles(tiles, dims, reach)
    asked = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("tile"))
    opened = asked.join(tiles.select("tile", "cls", "weight", "vec"), "tile").groupBy("x", "y").applyInArrow(lambda t: _opened(t, mean, directions, least, leaf), "a long, b long, degree long")
    found = materialize(opened, "found")
    discard(tiles, pairs)
    degrees = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("degree").alias("degree"))
    comps = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "cls")
    known = classes.select("cls", "rep", "weight", "vec").join(degrees, "cls", "left").join(comps, "cls", "left")
    known = materialize(known.withColumn("component", F.coalesce("component", "cls")), "known")
    least_id = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(least_id, "component").select("vec", (F.col("weight") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), "component_id")

    linked = base.where(good).join(known, "vec").select("id", "n_links", "component_id")
    alone = base.where(~good).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_epsilon_grid": op12_epsilon_grid}

ORACLE_SQL = {
    "op12_epsilon_grid": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
        ), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
        ), r(id, root) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a
        ), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id), d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN d ON d.a = e.vec_id
    """,
}

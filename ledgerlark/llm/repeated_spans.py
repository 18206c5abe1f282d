"""Exact removal of repeated byte strings by hash-compared suffix sorting.

Wherever a string of LENGTH bytes repeats, both places have the same content-defined anchors: positions whose gram of
half that length has the smallest hash of some stretch of grams. Grams that occur once are dropped. The bytes around
the other anchors are its contexts; equal ones are counted as one before anything is dealt, and their owners are joined
back at the end. In each gram's group the texts to the right of the anchor, and to the left read backwards, are
mergesorted. Two suffixes are compared by binary search for their common extension over prefix polynomial hashes, and
neighbours are verified byte by byte. A window around an anchor repeats when another context shares its bytes on both
sides. A group with more different contexts than a task sorts is divided by offsets: all windows of a range of offsets
share their middle, so contexts cut to that range fall into smaller groups by those bytes, which are sorted alike. Whole
copies of a document are settled beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import _BYTE, _ODD, _U, buffers, discard, materialize, mix, powers, prefix_hash
from ledgerlark.session import table

#: Contexts that a task gathers before it sorts; different contexts of a group above which it is divided; parts of a division.
BLOCK, MOST, PARTS = 4096, 8192, 6


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + width] for every i."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors in buf and the hashes of their grams, of length // 2 bytes."""
    gram = length // 2
    stretch = length - gram + 1
    if len(buf) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    p = prefix_hash(buf)
    h = mix((p[gram:] - p[:-gram]) * powers(len(buf) + 1)[1][: len(buf) - gram + 1])
    order = (h >> _U(33)).astype(np.uint32) + np.uint32(1)
    least = _sliding(order, stretch, np.minimum)
    inside = np.zeros(len(buf) + 1, dtype=np.int32)  # windows that lie in one document
    starts, ends = offs[:-1], offs[1:] - length + 1
    real = ends > starts
    np.add.at(inside, starts[real], 1)
    np.add.at(inside, ends[real], -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    padded = np.concatenate([np.zeros(stretch - 1, dtype=np.uint32), least, np.zeros(stretch - 1, dtype=np.uint32)])
    chosen = np.flatnonzero(_sliding(padded, stretch, np.maximum)[: len(order)] == order)
    return chosen, h[chosen]


def _anchored(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in buffers(batch.column("text"), 1 << 20):
            at, h = anchors(buf, offs, length)
            doc = np.searchsorted(offs, at, "right") - 1
            rk = batch.column("rk").to_numpy()[lo:hi][doc]
            yield pa.RecordBatch.from_arrays([pa.array(rk), pa.array((at - offs[doc]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array((mix(h + _ODD[3]) >> _U(33)).astype(np.int32))], names=["rk", "pos", "gram", "more"])


def _named(left: int, context: bytes) -> bytes:
    """What a context is known by."""
    return hashlib.blake2b(b"%d " % left + context, digest_size=16).digest()


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes around live anchors; those that agree in a slice of rows are one with several owners."""
    gram = length // 2
    for batch in batches:
        marks = batch.column("marks").to_pylist()
        rks, docs = batch.column("rk").to_pylist(), batch.column("doc").to_pylist()
        for lo, hi, buf, offs in buffers(batch.column("text"), 1 << 20):
            found: dict[tuple[int, int, bytes], list] = {}
            for i in range(lo, hi):
                kinds = {m["kind"] for m in marks[i] or ()}
                if not kinds or 1 in kinds:  # no repeat, or a copy that another row stands for
                    continue
                text = buf[offs[i - lo] : offs[i - lo + 1]].tobytes()
                for m in marks[i]:
                    if m["kind"] == 0:
                        a = max(0, m["pos"] - length + gram)
                        entry = found.setdefault((m["gram"], m["pos"] - a, text[a : m["pos"] + length]), [0, []])
                        entry[0] += 2 if 2 in kinds else 1
                        if 2 not in kinds:
                            entry[1].append((rks[i], docs[i], m["pos"]))
            if found:
                owners = [o for v in found.values() for o in v[1]]
                lists = pa.ListArray.from_arrays(
                    np.cumsum([0, *(len(v[1]) for v in found.values())]).astype(np.int32),
                    pa.StructArray.from_arrays([pa.array([o[0] for o in owners], pa.int64()), pa.array([o[1] for o in owners], pa.int64()), pa.array([o[2] for o in owners], pa.int32())], names=["rk", "doc", "pos"]),
                )
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[0] for k in found], pa.int64()), pa.array([_named(k[1], k[2]) for k in found], pa.binary()), pa.array([k[1] for k in found], pa.int32()),
                    pa.array([k[2] for k in found], pa.binary()), pa.array([v[0] for v in found.values()], pa.int64()), lists,
                ], names=["gram", "ctx", "left", "context", "held", "owners"])


class Suffixes:
    """Strings of at most some hundred bytes with prefix polynomial hashes; sorted within their groups."""

    def __init__(self, group: np.ndarray, texts: np.ndarray, lengths: np.ndarray) -> None:
        self.group, self.texts, self.lengths = group, texts, lengths
        self.prefix = np.zeros((len(texts), texts.shape[1] + 1), dtype=np.uint64)
        np.cumsum(_BYTE[texts] * powers(texts.shape[1])[0], axis=1, out=self.prefix[:, 1:])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings a and b, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.lengths[a], self.lengths[b])
        for _ in range(int(self.texts.shape[1]).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether strings a sort before strings b; ties tells what holds for equal ones."""
        common = self.extension(a, b)
        la, lb = self.lengths[a], self.lengths[b]
        last = self.texts.shape[1] - 1
        x, y = self.texts[a, np.minimum(common, last)], self.texts[b, np.minimum(common, last)]
        ended = (common >= la) | (common >= lb)
        less = np.where(ended, (la < lb) | ((la == lb) & ties), x < y)
        return (self.group[a] < self.group[b]) | ((self.group[a] == self.group[b]) & less)

    def order(self) -> np.ndarray:
        """Bottom-up mergesort: in each pass every element finds its rank in the neighbouring run by binary search."""
        n = len(self.texts)
        order, width, at = np.arange(n), 1, np.arange(n)
        while width < n:
            run = at // width
            mate = (run ^ 1) * width
            low, high = np.minimum(mate, n), np.minimum(mate + width, n)
            first, right = low.copy(), run & 1 == 1
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                goes = np.empty(len(open_), dtype=bool)
                r = right[open_]
                # Equal elements of the left run stay before those of the right one.
                goes[r] = self.before(order[mid[r]], order[open_[r]], True)
                goes[~r] = self.before(order[mid[~r]], order[open_[~r]], False)
                low[open_] = np.where(goes, mid + 1, low[open_])
                high[open_] = np.where(goes, high[open_], mid)
            place = (run & ~1) * width + (at - run * width) + (low - first)
            merged = np.empty_like(order)
            merged[place] = order
            order, width = merged, width * 2
        return order

    def sorted_with_common(self) -> tuple[np.ndarray, np.ndarray]:
        """The order and each string's common prefix with the one before (-1 in another group), verified by bytes."""
        order = self.order()
        a, b = order[:-1], order[1:]
        common = self.extension(a, b)
        limit = np.minimum(self.lengths[a], self.lengths[b])
        differ = self.texts[a] != self.texts[b]
        real = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), self.texts.shape[1]), limit)
        if (real != common).any():  # two strings with one hash: the bytes decide
            order = np.array(sorted(range(len(self.texts)), key=lambda i: (self.group[i], self.texts[i, : self.lengths[i]].tobytes())), dtype=np.int64)
            a, b = order[:-1], order[1:]
            differ = self.texts[a] != self.texts[b]
            common = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), self.texts.shape[1]), np.minimum(self.lengths[a], self.lengths[b]))
        return order, np.concatenate([[-1], np.where(self.group[a] == self.group[b], common, -1)])


def _matrix(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(len(texts), width)
    return out, lengths


def repeated_windows(group: np.ndarray, contexts: list[bytes], left: np.ndarray, held: np.ndarray, length: int) -> np.ndarray:
    """contexts x offsets: whether the window that starts offset bytes before the anchor occurs twice or more."""
    reach = length - length // 2
    right, nr = _matrix([c[x:] for c, x in zip(contexts, left.tolist(), strict=True)], length)
    back, nl = _matrix([c[:x][::-1] for c, x in zip(contexts, left.tolist(), strict=True)], reach)
    ro, rc = Suffixes(group, right, nr).sorted_with_common()
    lo, lc = Suffixes(group, back, nl).sorted_with_common()
    out = np.zeros((len(contexts), reach + 1), dtype=bool)
    ranks_r, ranks_l = np.empty(len(contexts), dtype=np.int64), np.empty(len(contexts), dtype=np.int64)
    for j in range(reach + 1):
        rows = np.flatnonzero((nl >= j) & (nr >= length - j))
        if len(rows):
            ranks_r[ro], ranks_l[lo] = np.cumsum(rc < length - j), np.cumsum(lc < j)
            _, back_to = np.unique(ranks_r[rows] * (len(contexts) + 1) + ranks_l[rows], return_inverse=True)
            out[rows, j] = np.bincount(back_to, weights=held[rows])[back_to] >= 2
    return out


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts cut to each of PARTS ranges of their group's offsets lo to hi, in groups by the bytes that all windows of
    such a range share."""
    names = ["ctx", "left", "context", "held", "lo", "hi"]
    out_names = ["parent", "gram", "ctx", "left", "context", "held", "lo", "hi"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=out_names)

    for batch in batches:
        rows = []
        for ctx, left, context, held, lo, hi in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            step = -(-(hi - lo + 1) // PARTS)
            for low in range(lo, hi + 1, step):
                high = min(low + step - 1, hi)
                a, b = max(low, length - (len(context) - left)), min(high, left)  # the offsets that it has bytes for
                if a <= b:
                    core = hashlib.blake2b(b"%d %d " % (low, high) + context[left - low : left + length - high], digest_size=8).digest()
                    cut = context[left - b : left + length - a]
                    rows.append((ctx, int.from_bytes(core, "little", signed=True), _named(b, cut), b, cut, held, low, high))
                    if len(rows) >= BLOCK:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)


def _resolved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The range of offsets whose windows repeat, of each context that has one; contexts come sorted by group, each once."""
    groups: list[int] = []
    rows: list[tuple[bytes, int, bytes, int]] = []

    def settle() -> pa.RecordBatch:
        left, held = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 3))
        size = np.array([len(r[2]) for r in rows], dtype=np.int64)
        reach = length - length // 2
        low, high = np.maximum(0, length - (size - left)), np.minimum(left, reach)
        new = np.concatenate([[True], np.diff(np.array(groups)) != 0])
        group = np.cumsum(new)
        met = np.bincount(group)[group] > 1
        hit = held > 1  # every window of a context that occurs twice repeats
        asked = np.flatnonzero(met)
        if len(asked) and not hit[asked].all():
            seen = repeated_windows(group[asked], [rows[i][2] for i in asked.tolist()], left[asked], held[asked], length)
            some = seen.any(axis=1)
            low[asked] = np.where(some, seen.argmax(axis=1), low[asked])
            high[asked] = np.where(some, reach - seen[:, ::-1].argmax(axis=1), high[asked])
            hit[asked] |= some
        hit &= low <= high
        kept = np.flatnonzero(hit)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in kept.tolist()], pa.binary()), pa.array(low[kept].astype(np.int32)), pa.array(high[kept].astype(np.int32))], names=["ctx", "a", "b"])

    for batch in batches:
        for gram, *row in zip(*(batch.column(x).to_pylist() for x in ("gram", "ctx", "left", "context", "held")), strict=True):
            if len(rows) >= BLOCK and gram != groups[-1]:
                yield settle()
                groups.clear()
                rows.clear()
            groups.append(gram)
            rows.append(tuple(row))
    if rows:
        yield settle()


def repeated_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """(gram, ctx, left, context, held), each context once -> ctx, a, b: windows that start a to b bytes before the anchor
    cover exactly what repeats around it."""
    columns = ["gram", "ctx", "left", "context", "held", "lo", "hi"]
    level = contexts.withColumns({"lo": F.lit(0), "hi": F.lit(length - length // 2)})
    ready, parents = [], []
    while True:
        large = materialize(level.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("gram"), "large")
        if large.isEmpty():
            ready.append(level)
            break
        ready.append(level.join(large, "gram", "left_anti"))
        cut = level.join(large, "gram", "left_semi").select(columns).mapInArrow(lambda it: _parts(it, length), "parent binary, gram long, ctx binary, left int, context binary, held long, lo int, hi int")
        cut = materialize(cut, "parts")
        parents.append(cut.select("parent", "ctx").distinct())
        level = materialize(cut.groupBy("gram", "ctx", "left", "context", "lo", "hi").agg(F.sum("held").alias("held")), "level")
    rows = ready[0].select("gram", "ctx", "left", "context", "held")
    for x in ready[1:]:
        rows = rows.unionByName(x.select("gram", "ctx", "left", "context", "held"))
    found = materialize(rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(lambda it: _resolved(it, length), "ctx binary, a int, b int"), "ranges")
    for links in reversed(parents):
        up = links.join(found, "ctx").select(F.col("parent").alias("ctx"), "a", "b")
        found = materialize(found.unionByName(up), "ranges")
    return found.groupBy("ctx").agg(F.min("a").alias("a"), F.max("b").alias("b")) if parents else found


def _cleaned(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, docs = batch.column("spans").to_pylist(), batch.column("doc").to_pylist()
        for lo, hi, buf, offs in buffers(batch.column("text")):
            rows = []
            for i in range(lo, hi):
                text = buf[offs[i - lo] : offs[i - lo + 1]].tobytes()
                merged: list[list[int]] = []
                for a, b in sorted((s["begin"], s["stop"]) for s in spans[i] or () if s["doc"] == docs[i]):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                ends = [0, *(x for m in merged for x in m), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((len(text), len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest))
            out = [batch.column("doc_id").slice(lo, hi - lo), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                out.append(pa.array([r[4].decode("utf-8", "replace") for r in rows], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names=names)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text if asked for).

    Every byte covered by a string of length bytes that also starts anywhere else, in the same text included, is
    removed; strings are judged on the input and never cross texts. A null text is empty. Repeated rows are copies of
    each other, so they lose everything if they are long enough; ids may repeat or be null. A cut inside a character
    leaves replacement characters in kept_text only. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_type = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("doc"), F.xxhash64("doc_id", "text").alias("rk"), "text")
    long_ = base.where(F.octet_length("text") >= length)
    found = long_.select("rk", "text").mapInArrow(lambda it: _anchored(it, length), "rk long, pos int, gram long, more int")
    found = materialize(found, "anchors")
    # Grouped by the gram and joined on more bits too: the join deals rows anew, so that a hot gram is split.
    often = found.groupBy("gram").agg(F.count("*").alias("n"), F.max("more").alias("more")).where("n > 1")
    live = found.join(often, ["gram", "more"]).select("rk", F.lit(0).alias("kind"), "pos", "gram")
    prints = materialize(long_.select("rk", "doc", F.xxhash64("text").alias("p"), F.crc32("text").alias("q"), F.octet_length("text").cast("bigint").alias("n")), "prints")
    classes = prints.groupBy("p", "q").agg(F.count("*").alias("held"), F.min("rk").alias("first"), F.max("n").alias("n")).where("held > 1")
    copies = materialize(prints.join(classes, ["p", "q", "n"]).select("rk", "doc", "n", F.when(F.col("rk") == F.col("first"), 2).otherwise(1).alias("kind")), "copies")
    discard(prints)
    marks = live.unionByName(copies.select("rk", "kind", F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("gram")))
    marks = materialize(marks.groupBy("rk").agg(F.collect_set(F.struct("kind", "pos", "gram")).alias("marks")), "marks")
    discard(found)

    around = base.join(marks.hint("shuffle_merge"), "rk").select("rk", "doc", "text", "marks")
    schema = "gram long, ctx binary, left int, context binary, held long, owners array<struct<rk: long, doc: long, pos: int>>"
    contexts = materialize(around.mapInArrow(lambda it: _contexts(it, length), schema), "contexts")
    discard(marks)
    different = materialize(contexts.groupBy("gram", "ctx", "left", "context").agg(F.sum("held").alias("held")), "different")
    ranges = repeated_ranges(different, length).withColumn("more", F.xxhash64("ctx"))
    # Joined on a column more than ranges are grouped by, so that both sides are dealt anew and a hot passage is split.
    owned = contexts.select("ctx", F.xxhash64("ctx").alias("more"), F.explode("owners").alias("o")).join(ranges, ["ctx", "more"])
    spans = owned.select("o.rk", "o.doc", (F.col("o.pos") - F.col("b")).cast("bigint").alias("begin"), (F.col("o.pos") - F.col("a") + length).cast("bigint").alias("stop"))
    spans = spans.unionByName(copies.select("rk", "doc", F.lit(0).cast("bigint").alias("begin"), F.col("n").alias("stop")))
    spans = materialize(spans.groupBy("rk").agg(F.collect_set(F.struct("doc", "begin", "stop")).alias("spans")), "spans")
    discard(contexts, different, copies)
    cleaned = base.join(spans.hint("shuffle_merge"), "rk", "left").select("doc_id", "rk", "doc", "text", "spans")
    return cleaned.mapInArrow(lambda it: _cleaned(it, texts), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts)


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op10_suffix_repeats": op10_suffix_repeats}

#: Every window by its digest, over the bytes as hexadecimal digits.
ORACLE_SQL = {
    "op10_suffix_repeats": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
        ), l AS (SELECT r, doc_id, x, length(x) // 2 AS n FROM d
        ), w AS MATERIALIZED (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(n - 399)) AS i FROM l WHERE n >= 400)
        ), c AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1
        ), e AS (SELECT r, i, CASE WHEN i > 400 + lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM c
        ), s AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM e
        ), runs AS (SELECT r, k, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY 1, 2
        ), keep AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM runs UNION ALL SELECT r, max(b), NULL FROM runs GROUP BY 1
        ), rest AS (SELECT keep.r, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS x FROM keep JOIN l USING (r) GROUP BY 1
        ), gone AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans FROM runs GROUP BY 1
        )
        SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN rest.r IS NULL THEN l.x ELSE coalesce(rest.x, '') END)) AS kept_sha256
        FROM l LEFT JOIN gone USING (r) LEFT JOIN rest USING (r)
    """,
}

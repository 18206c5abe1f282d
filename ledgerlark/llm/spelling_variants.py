"""Spelling variants: words one inserted, deleted or replaced letter apart, found in a frequency-vector trie.

Letters fall into groups, and a word's vector counts its letters of each group. One edit raises at most one count by one
and lowers at most one by one, so in a trie whose levels are the successive counts a depth-first search that may spend
one surplus and one deficit meets every near word; what it meets at the leaves is verified letter by letter.

The first counts of the vector, the top of the trie, deal words to subtries, and each word as a query to the subtries
that its budget reaches. A subtrie with more words than a task should hold is cut into chunks, and its queries go to each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import discard, materialize
from ledgerlark.session import table

#: Letters of a word once A-Z is lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Groups of letters, the first of which are the top of the trie; words of a chunk and queries sent to it at a time;
#: words that a task counts before it passes them on.
GROUPS, TOP, CHUNK, QUERIES_A_TASK, HELD = 14, 4, 8192, 32768, 400_000
#: Nodes with at most this many words are searched as one; longer words than this are compared one by one.
LEAF, LONG = 16, 48


def _counted(batches: Iterator[pa.RecordBatch], thin: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts, each word perhaps several times."""
    find, held = re.compile(f"[{LETTERS}]+").findall, Counter()

    def passed_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
            if not text.is_valid:
                continue
            # bytes.lower() changes A-Z alone.
            runs = Counter(find(text.as_buffer().to_pybytes().lower().decode("utf-8", "replace")))
            if thin:
                start = zlib.crc32(f"{'' if doc.as_py() is None else doc.as_py()}:".encode())
                for run in [w for w in runs if zlib.crc32(w.encode(), start) % thin == 0]:
                    at = zlib.crc32(run.encode(), start) % len(run)
                    held[run[:at] + run[at + 1 :]] += runs.pop(run)
            held.update(runs)
            if len(held) > HELD:
                yield passed_on()
    if held:
        yield passed_on()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thin: int = 97, least_letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n): maximal runs of letters of the whole texts with A-Z lower-cased, those of at least `least_letters` code
    points that occur at least `least` times. Of the runs of a document whose hash with its id is divisible by `thin`
    one letter is lost first (0: of none)."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = texts.mapInArrow(lambda it: _counted(it, thin), "word string, n long")
    return counts.where(F.length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> dict[str, int]:
    """A group for each letter, dealt to and fro by frequency, so that groups hold about equally many. The alphabet has
    90 letters at most, so this table has a bounded size."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    ranked = [r.letter for r in sorted(letters.collect(), key=lambda r: (-r["count"], r.letter))]
    return {x: i % groups if i // groups % 2 == 0 else groups - 1 - i % groups for i, x in enumerate(ranked)}


def vectors(words: list[str], group_of: dict[str, int], groups: int = GROUPS) -> np.ndarray:
    """Letters of each group in each word."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    table_ = np.zeros(256, dtype=np.int64)
    table_[[ord(x) for x in group_of]] = list(group_of.values())
    codes = table_[np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)]
    out = np.bincount(np.repeat(np.arange(len(words)), lens) * groups + codes, minlength=len(words) * groups)
    return out.reshape(len(words), groups)


def _routes() -> np.ndarray:
    """Changes of the top counts within a budget of one surplus and one deficit: none, one of either, or one of both. Of
    a change and its opposite the one whose first entry is positive is kept, as each pair must meet once."""
    out = [np.zeros(TOP, dtype=np.int64)]
    for i in range(TOP):
        for j in range(-1, TOP):
            if i != j:
                step = np.zeros(TOP, dtype=np.int64)
                step[i] += 1
                if j >= 0:
                    step[j] -= 1
                if step[np.flatnonzero(step)[0]] > 0:
                    out.append(step)
    return np.array(out)


def _topped(batches: Iterator[pa.RecordBatch], group_of: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Each word with its place at the top of the trie."""
    for batch in batches:
        top = vectors(batch.column("word").to_pylist(), group_of)[:, :TOP]
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array([",".join(map(str, x)) for x in top.tolist()], pa.string())], names=["word", "n", "subtrie"])


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word as a query to every subtrie within its budget."""
    routes = _routes()
    for batch in batches:
        tops = np.array([[int(x) for x in t.split(",")] for t in batch.column("subtrie").to_pylist()], dtype=np.int64).reshape(-1, TOP)
        to = tops[:, None, :] + routes[None]
        rows, way = np.nonzero((to >= 0).all(axis=2))
        names = [",".join(map(str, x)) for x in to[rows, way].tolist()]
        yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(rows)), batch.column("n").take(pa.array(rows)), pa.array(names, pa.string()), pa.array(way == 0)], names=["word", "n", "subtrie", "home"])


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    n = len(a)
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(b) > n else i < n and a[i + 1 :] == b[i + 1 :]


def search(words: np.ndarray, queries: np.ndarray, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, words) whose vectors differ by at most one surplus and one deficit: a depth-first search of the trie of
    `words`, whose rows are sorted, for all queries at once. A query leaves the search where it has spent more."""
    depth_end = words.shape[1]
    ones = np.ones(len(queries), dtype=np.int8)
    todo = [(0, len(words), 0, np.arange(len(queries)), ones, ones)]
    words, queries = words.astype(np.int32), queries.astype(np.int32)
    while todo:
        lo, hi, depth, asked, surplus, deficit = todo.pop()
        if hi - lo <= leaf or depth == depth_end:
            diff = queries[asked, None, depth:] - words[None, lo:hi, depth:]
            fits = (np.maximum(diff, 0).sum(axis=2) <= surplus[:, None]) & (np.maximum(-diff, 0).sum(axis=2) <= deficit[:, None])
            q, w = np.nonzero(fits)
            yield asked[q], w + lo
            continue
        column = words[lo:hi, depth]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [hi - lo]])
        mine = queries[asked, depth]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            diff = mine - int(column[s])
            left_s, left_d = surplus - np.maximum(diff, 0), deficit - np.maximum(-diff, 0)
            go = np.flatnonzero((left_s >= 0) & (left_d >= 0))
            if len(go):
                todo.append((lo + s, lo + e, depth + 1, asked[go], left_s[go].astype(np.int8), left_d[go].astype(np.int8)))


class _Letters:
    """The words of a task as rows of letters, once from the left and once from the right, to compare many pairs at once."""

    def __init__(self, words: list[str]):
        self.words, self.lens = words, np.fromiter(map(len, words), np.int64, len(words))
        width = min(LONG, int(self.lens.max(initial=0))) + 1
        self.left, self.right = (np.frombuffer("".join(x).encode("latin-1"), dtype=np.uint8).reshape(-1, width) for x in ([w[:width].ljust(width, "\0") for w in words], [w[-width:].rjust(width, "\0") for w in words]))

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For which of the pairs (x, y) exactly one edit leads from word to word."""
        out = np.zeros(len(x), dtype=bool)
        for at in range(0, len(x), 1 << 16):
            a, b = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
            la, lb = self.lens[a], self.lens[b]
            differ = self.left[a] != self.left[b]
            shorter = np.minimum(la, lb)
            from_right = self.right[a] != self.right[b]
            # Letters that agree from the left and from the right must cover the shorter word.
            covered = np.where(differ.any(axis=1), differ.argmax(axis=1), shorter) + np.where(from_right.any(axis=1), from_right[:, ::-1].argmax(axis=1), shorter)
            out[at : at + (1 << 16)] = np.where(la == lb, differ.sum(axis=1) == 1, covered >= shorter)
            for i in np.flatnonzero(np.maximum(la, lb) > LONG).tolist():
                out[at + i] = near(self.words[a[i]], self.words[b[i]])
        return out


def _searched(t: pa.Table, group_of: dict[str, int]) -> pa.Table:
    """Near words met in one chunk of a subtrie: for each word their number, and the best of them."""
    roles = t.column("role").to_numpy()
    names, counts = t.column("word").to_pylist(), t.column("n").to_numpy()
    ours, theirs = np.flatnonzero(roles == 0), np.flatnonzero(roles != 0)
    found, best = np.zeros(len(names), dtype=np.int64), np.full(len(names), len(names))
    ranked = np.array(sorted(range(len(names)), key=lambda i: (-counts[i], names[i])), dtype=np.int64)
    rank = np.empty(len(names), dtype=np.int64)
    rank[ranked] = np.arange(len(names))
    if len(ours) and len(theirs):
        of, letters = vectors(names, group_of).astype(np.int32), _Letters(names)
        ours = ours[np.lexsort(of[ours].T[::-1])]
        home = roles[theirs] == 2
        # At home both words ask each other: there the one of lower rank speaks.
        for q, w in search(of[ours], of[theirs]):
            x, y = theirs[q], ours[w]
            go = ~home[q] | (rank[x] < rank[y])
            x, y = x[go], y[go]
            go = letters.near(x, y)
            x, y = x[go], y[go]
            for i, j in ((x, y), (y, x)):
                np.add.at(found, i, 1)
                np.minimum.at(best, i, rank[j])
    at = np.flatnonzero(found)
    chosen = ranked[best[at]]
    return pa.table({"word": t.column("word").take(pa.array(at)), "n_near": pa.array(found[at]), "best_n": pa.array(counts[chosen]), "best": t.column("word").take(pa.array(chosen))})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) of distinct words -> word, n_near, best_n, best for those with near words; best has the largest n, of
    equal ones it is the first in code-point order."""
    group_of = letter_groups(words)
    homes = materialize(words.mapInArrow(lambda it: _topped(it, group_of), "word string, n long, subtrie string"), "homes")
    parts = homes.groupBy("subtrie").agg(F.expr(f"cast(ceil(count(*) / {CHUNK}) as int)").alias("chunks"))
    parts = materialize(parts, "subtries")
    asked = homes.mapInArrow(_routed, "word string, n long, subtrie string, home boolean").join(parts, "subtrie")
    turns = asked.groupBy("subtrie").agg(F.expr(f"cast(ceil(count(*) / {QUERIES_A_TASK}) as int)").alias("turns"))
    turns = materialize(turns, "turns")
    owned = homes.join(parts, "subtrie").join(turns, "subtrie").select("subtrie", F.expr("pmod(xxhash64(word), chunks)").alias("chunk"), F.explode(F.expr("sequence(0, turns - 1)")).alias("turn"), "word", "n", F.lit(0).alias("role"))
    asking = asked.join(turns, "subtrie").select("subtrie", F.explode(F.expr("sequence(0L, chunks - 1L)")).alias("chunk"), F.expr("cast(pmod(xxhash64(word, 5), turns) as int)").alias("turn"), "word", "n", F.when(F.col("home"), 2).otherwise(1).alias("role"))
    met = owned.unionByName(asking).groupBy("subtrie", "chunk", "turn").applyInArrow(lambda t: _searched(t, group_of), "word string, n_near long, best_n long, best string")
    # A word's best of several chunks: the largest n, then the smallest word.
    met = met.groupBy("word", "best_n").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    out = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max(F.col("best_n")).alias("best_n"), F.max_by("best", "best_n").alias("best"))
    out = materialize(out, "met")
    discard(homes, parts, turns)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root) for words with a form. A form is at least twice as frequent as its word, so ways end;
    every round doubles how far a word has looked."""
    ways = materialize(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        upper = ways.select(F.col("word").alias("root"), F.col("root").alias("upper"))
        longer = ways.join(upper, "root", "left").select("word", F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved"))
        longer = materialize(longer, "ways")
        discard(ways)
        if not longer.where("moved").limit(1).count():
            return longer.select("word", "root")
        ways = longer.select("word", "root")
        ways._written_at = longer._written_at


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n) of distinct words -> word, form, root, n, n_near, form_n.

    A word's form is the most frequent of its near words, ties going to the first in code-point order, if that is at
    least `times` as frequent; root is the last form on the way from form to form, the word itself without one. Words
    without letters of LETTERS aren't expected. An empty table gives an empty result.
    """
    words = materialize(words, "counts")
    known = words.join(near_words(words), "word", "left")
    chosen = F.col("best_n") >= times * F.col("n")
    known = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")), "variants")
    ends = roots(known.where("form is not null").select("word", "form"))
    out = known.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no words; a null id is hashed as an empty one; texts are read whole, whatever their length; repeated
    rows count each time; columns beside id and text are ignored."""
    return variants(count_words(table(spark, sf_dir, "documents")))


QUERIES = {"op13_spelling_trie": op13_spelling_trie}

"""Merkle manifest, epsilon grid join and spelling variants against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import grid_join, merkle_manifest, spelling_variants


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- op11 ----

DOCS = "doc_id long, text string, lang string, source string, n_chars int, key string, pos long, digest string, height int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, "clash", 3) for r in rows], DOCS)


def leaf(row, text=None):
    i, t, lang, source, n = row
    values = [i, source, lang, n, t if text is None else text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, i):
    for nodes in levels[:-1]:
        lo = i - i % 8
        yield nodes[lo:i], nodes[i + 1 : lo + 8]
        i //= 8


def expected(rows, hit):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree_of([leaf(r) for r in groups[g]])
    top = tree_of([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            way = [*beside(trees[g], i), *beside(top, k)]
            node = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1])) if hit(r) and r[1] is not None else leaf(r)
            for before, after in way:
                node = sha("".join(before) + node + "".join(after))
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join("".join(b + a) for b, a in way)), node))
    return out


def hit(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0


def manifest_of(spark, rows):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle_manifest.manifest(docs_frame(spark, rows), changed={"text": lowered}, when=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def some_docs(sizes, seed=1):
    r = random.Random(seed)
    out = []
    for lang, n in sizes.items():
        out += [(r.randrange(10 * n) if n > 1 else 5, r.choice(["", None, "Ünï Text", "plain words", "UPPER lower " * r.randrange(9)]), lang, r.choice([None, "a", "b"]), r.choice([None, 3, 12])) for _ in range(n)]
    return out + out[:3] + [(None, "No Id", "en", "s", 1), (None, None, None, None, None)]


@pytest.mark.parametrize("sizes", [{"en": 1400, "de": 513, "fr": 9, "es": 1, None: 8, "é": 64}, {"en": 3}, {f"l{i}": 2 for i in range(20)}])
def test_manifest_equals_brute_force(spark, sizes):
    rows = some_docs(sizes)
    got = [tuple(x) for x in manifest_of(spark, rows).rows.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root").collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(rows, hit)))


def test_manifest_edges(spark):
    assert manifest_of(spark, []).rows.count() == 0
    one = (7, None, None, None, None)
    got = manifest_of(spark, [one]).rows.collect()[0]
    assert (got.leaf, got.subroot, got.root, got.proof_sha256) == (leaf(one), leaf(one), leaf(one), sha(""))


def test_version_shares_untouched_nodes(spark):
    rows = [(i, f"Text {i}", "en", "s", 1) for i in range(700)]
    made = manifest_of(spark, rows)
    changed = next(i for i in range(300, 700) if zlib.crc32(str(i).encode()) % 3 == 0)
    now = tree_of([leaf(r, f"text {i}") if i == changed else leaf(r) for i, r in enumerate(rows)])
    version = {(x.level, x.idx): x.digest for x in made.version(changed).collect()}
    assert version == {(k, i): d for k, nodes in enumerate(now) for i, d in enumerate(nodes)}
    base = {(x.level, x.idx): x.digest for x in made.nodes.where("key is not null").collect()}
    assert sum(version[k] != base[k] for k in base) == len(now)


# ---- op12 ----


def linked_by_force(rows, least):
    """{place: (links, component)} of (id, vector) rows."""
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {k: (0, rows[k][0]) for k in range(len(rows))}
    near = {k: set() for k in good}
    for a in good:
        for b in good:
            x, y = (np.array(rows[k][1], dtype=np.float64) for k in (a, b))
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                near[a].add(b)
    seen = set()
    for k in good:
        if k in seen:
            continue
        group, todo = set(), [k]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        seen |= group
        for x in group:
            out[x] = (len(near[x]), min(rows[y][0] for y in group))
    return out


def some_vectors(dims=12, seed=5):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(12):
        middle = r.normal(size=dims)
        out += [(middle + r.normal(size=dims) * r.choice([0.0, 0.02, 0.1, 0.16])).astype(np.float32).tolist() for _ in range(r.integers(1, 40))]
    tight = r.normal(size=dims)
    out += [(tight + r.normal(size=dims) * 1e-3).astype(np.float32).tolist() for _ in range(150)]
    out += [r.normal(size=dims).astype(np.float32).tolist() for _ in range(60)]
    out += [out[3]] * 20 + [[2 * x for x in out[3]], [0.0] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [1.0] * (dims - 1), [2.0] * (dims - 1), [1.0] * (dims + 3), [], None, [None] * dims]
    ids = list(range(len(out)))
    random.Random(seed).shuffle(ids)
    return list(zip(ids, out, strict=True))


VECS = "vec_id long, embedding array<float>, label int, cls long, weight long, pos long, c0 int, rep long"


@pytest.mark.parametrize(("tile", "small"), [(4096, 128), (64, 8), (37, 5)])
def test_grid_join_equals_brute_force(spark, monkeypatch, tile, small):
    monkeypatch.setattr(grid_join, "TILE", tile)
    monkeypatch.setattr(grid_join, "LEAF", small)
    monkeypatch.setattr(grid_join, "FAN", 3)
    rows = some_vectors() + [(None, [1.0] * 12)]
    got = grid_join.grid_join(spark.createDataFrame([(*x, 0, 1, 2, 3, 4, 5) for x in rows], VECS)).collect()
    want = linked_by_force(rows, 0.95)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(rows[k][0], n, c, rows[k][0] is not None and c == rows[k][0]) for k, (n, c) in want.items()}
    assert len(got) == len(rows)


def test_grid_join_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert grid_join.grid_join(none).count() == 0
    huge = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (2, [1.0, -1.0]), (3, [-1e200, 1e200])]
    got = sorted(tuple(r) for r in grid_join.grid_join(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (2, 0, 2, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_far_intervals_are_skipped():
    """Two far families: no product of one with the other is made, and a tight family is counted without any."""
    r = np.random.default_rng(1)
    a, b = (c + 1e-4 * r.normal(size=(300, 8)) for c in (np.eye(8)[0], np.eye(8)[1]))
    mean, directions = np.zeros(8), np.eye(8)[:, :2]
    tiles = [grid_join._Tile(np.arange(300), np.ones(300), x, mean, directions) for x in (a, b)]
    left, right, links = grid_join.join_tiles(*tiles, 0.95)
    assert not left.any() and not right.any() and not links and len(tiles[0]._held) == 1
    counts, _, links = grid_join.join_tiles(tiles[0], tiles[0], 0.95)
    assert (counts == 299).all() and len(tiles[0]._held) == 1


# ---- op13 ----


def edited(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_force(counts, times=2):
    near = {w: {x for x in counts if edited(w, x)} for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= times * counts[w]:
            form[w] = best
    out = set()
    for w in counts:
        end = w
        while end in form:
            end = form[end]
        out.add((w, form.get(w), end, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def some_words(n, seed=2):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéïÿ÷xyz") for _ in range(r.randrange(5, 9))) for _ in range(n // 6)]
    out = set(base)
    for _ in range(n):
        w = r.choice(base)
        i = r.randrange(len(w))
        out.add(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcz") + w[i:], w[:i] + r.choice("abcz") + w[i + 1 :]]))
    out |= {"m" * 60 + "n", "m" * 61 + "n", "m" * 30 + "n" + "m" * 30, "aaaaa", "aaaaaa", "aaaaaaa", "anagram", "nagaram"}
    return {w: r.choice([3, 3, 4, 7, 8, 16, 40]) for w in out}


def test_search_meets_what_the_budgets_reach():
    r = np.random.default_rng(3)
    words, queries = (np.unique(r.integers(0, 3, size=(n, 5)), axis=0) for n in (300, 80))
    met = {(int(a), int(b)) for leaf_size in (1, 9) for q, w in spelling_variants.search(words, queries, leaf_size) for a, b in zip(q, w, strict=True)}
    diff = queries[:, None] - words[None]
    assert met == set(zip(*map(np.ndarray.tolist, np.nonzero((np.maximum(diff, 0).sum(2) <= 1) & (np.maximum(-diff, 0).sum(2) <= 1))), strict=True))


@pytest.mark.parametrize(("chunk", "turn"), [(8192, 32768), (20, 50)])
def test_variants_equal_brute_force(spark, monkeypatch, chunk, turn):
    monkeypatch.setattr(spelling_variants, "CHUNK", chunk)
    monkeypatch.setattr(spelling_variants, "QUERIES_A_TASK", turn)
    counts = some_words(600)
    got = spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {tuple(r) for r in got} == variants_by_force(counts) and len(got) == len(counts)


def test_count_words_equals_brute_force(spark):
    r = random.Random(4)
    pool = ["Straße", "ÉTÉ", "Apple", "APPLE", "apples", "Łódź", "x1y2longer", "naïve×", "aaaaaa", "ﬁnest"]
    rows = [(r.choice([None, *range(40)]), " ".join(r.choice(pool) for _ in range(30)), "clash") for _ in range(200)] + [(1, None, ""), (2, "", ""), (3, "Apple " * 50_000, "")]
    want = Counter()
    for i, text, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 7 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    got = spelling_variants.count_words(spark.createDataFrame(rows, "doc_id long, text string, word string"), thin=7).collect()
    assert {tuple(x) for x in got} == {(w, n) for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_variants_of_an_empty_table(spark):
    assert spelling_variants.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_op13_equals_brute_force(spark, sf):
    want = Counter()
    for row in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", row.text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{row.doc_id}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    counts = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    got = spelling_variants.op13_spelling_trie(spark, sf).collect()
    assert {tuple(r) for r in got} == variants_by_force(counts)

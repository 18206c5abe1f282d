"""The operators on documents against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import common, decontamination, jaccard_join, language_id, mixing, quality_classifier, quality_rules, repeated_spans, sharding
from ledgerlark.session import table

SCHEMA = "doc_id long, text string, lang string, source string, sig string"
WORDS = [b.decode() for b in re.findall(rb"[^\x20\x09-\x0D]+", b"the of and in to be der die und la que alpha beta gamma delta")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def family(n=60, seed=3):
    """Random texts with copies, near copies, shared passages, nulls, empty, short and long ones."""
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.choice([3, 12, 60, 90]))) for _ in range(n // 3)]
    out = list(base)
    for _ in range(n):
        w = r.choice(base).split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "changed" + str(r.randrange(5))
        out.append(" ".join(w))
    out += [None, "", "  \t\n", "one", "one two", "ONE TWO", "one two", " ".join(base[:8]) * 40]
    return list(enumerate(out))


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, k, percent):
    rows = family()
    sets = {i: shingles(t, k) for i, t in rows}
    near = {i: {j for j in sets if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])} for i in sets}
    comp = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = comp.get(i, i)
                todo += near[x]
    alone = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(frame(spark, rows), k, percent, links=False).collect()}
    assert alone == {i: (len(sets[i]), comp[i]) for i in sets}
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(frame(spark, rows), k, percent, links=True).collect()}
    assert {i: (r.n_shingles, r.component_id, r.n_links) for i, r in got.items()} == {i: (len(sets[i]), comp[i], len(near[i])) for i in sets}


@pytest.mark.parametrize("inside", [0, 2])
def test_links_of_a_group_are_fewer_than_its_rows_and_connect_the_same(inside):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    whole = [np.unique(rng.integers(1, 1 << 60, 60, dtype=np.uint64)) for _ in range(3)]
    sets = [np.delete(whole[i % 3], rng.choice(60, rng.integers(0, 4), replace=False)) for i in range(120)]
    role = [inside if i < 60 else 1 for i in range(120)]
    got = jaccard_join._group_links(pa.table({"row": list(range(120)), "weight": [1] * 120, "role": role, "tokens": pa.array([s.tobytes() for s in sets], pa.binary())}), 90, False).to_pylist()

    def components(pairs):
        root = list(range(120))
        for a, b in pairs:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
        return root

    close = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))
    want = [(a, b) for a in range(120) for b in range(60) if a != b and (role[a] == 1 or inside) and close(a, b)]
    assert len(want) > 1000 and len(got) < 120
    assert components((r["a"], r["b"]) for r in got) == components(want)


def test_jaccard_join_edges(spark):
    empty = frame(spark, []).limit(0)
    assert jaccard_join.jaccard_join(empty).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A B C D"), (3, None)]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.n_shingles) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect())
    assert got == [(-1, -1, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0)]


def test_large_groups_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "QUERIES_A_TASK", 8)
    rows = [(i, " ".join(f"w{j}" if j != i else "x" for j in range(200))) for i in range(40)]
    got = jaccard_join.jaccard_join(frame(spark, rows), 3, 90, links=True).collect()
    assert {r.component_id for r in got} == {0}
    assert all(r.n_links == 39 for r in got)


def test_components_of_similar_families_are_exact(spark, monkeypatch):
    """Two families near the threshold to each other, chains of edits and strays, in groups much smaller than they are."""
    monkeypatch.setattr(jaccard_join, "GROUP", 5)
    monkeypatch.setattr(jaccard_join, "QUERIES_A_TASK", 7)
    r = random.Random(11)
    base = [f"w{j}" for j in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5, 9])):
            w[r.randrange(len(w))] = f"x{r.randrange(60)}"
        if i % 3 == 0:
            w[40:52] = [f"y{j}" for j in range(12)]
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    sets = {i: shingles(t, 5) for i, t in rows}
    comp = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = comp.get(i, i)
                todo += [j for j in sets if 100 * len(sets[x] & sets[j]) >= 80 * len(sets[x] | sets[j])]
    assert len(set(comp.values())) > 5
    got = jaccard_join.jaccard_join(frame(spark, rows), 5, 80, links=False).collect()
    assert {x.doc_id: x.component_id for x in got} == comp


def test_a_family_of_thousands_is_linked_without_all_pairs(spark, monkeypatch):
    opened = []
    inner = jaccard_join._opened
    monkeypatch.setattr(jaccard_join, "_opened", lambda held, own, asks, *a: opened.append(asks.count()) or inner(held, own, asks, *a))
    rows = [(i, " ".join(f"w{j}" if j != i % 150 else f"x{i}" for j in range(150))) for i in range(5000)]
    got = jaccard_join.jaccard_join(frame(spark, rows), 5, 80, links=False).collect()
    assert {x.component_id for x in got} == {0}
    assert sum(opened) < 5000


def test_a_set_of_any_size_has_parts():
    for n in (1, 7, 1 << 20, (1 << 24) + 5):
        classes = jaccard_join.size_classes(80, 1 << max(24, 2 * n.bit_length()))
        assert int(np.searchsorted(classes, n, "right")) + 1 < len(classes)


def repeats(docs, length):
    seen = Counter(d[i : i + length] for _, d in docs for i in range(len(d) - length + 1))
    out = {}
    for k, d in docs:
        cover = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i : i + length] = [True] * length
        kept = bytes(b for b, c in zip(d, cover, strict=True) if not c)
        out.setdefault(k, []).append((len(d), sum(cover), sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [16, 40])
def test_repeats_equal_brute_force(spark, length):
    rows = family(40, 5) + [(500, "ab" * 60), (501, "xyz" * 30 + "ab" * 9), (502, "é" * 50), (500, "ab" * 60), (None, None)]
    got: dict = {}
    for r in repeated_spans.remove_repeats(frame(spark, rows), length).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert got == repeats([(i, (t or "").encode()) for i, t in rows], length)


def test_repeats_of_large_groups_equal_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("MOST", 4)):
        monkeypatch.setattr(repeated_spans, name, value)
    divided = []
    ranges = repeated_spans.repeated_ranges
    monkeypatch.setattr(repeated_spans, "repeated_ranges", lambda c, length: divided.append(max(r["count"] for r in c.groupBy("gram").count().collect())) or ranges(c, length))
    r = random.Random(2)
    cut = lambda: "".join(r.choice("abc") for _ in range(r.randrange(30)))
    hot = "the hot passage that all of them share, whole or in part"
    rows = [(i, cut() + hot[r.choice([0, 0, 7, 20]) : r.choice([60, 60, 45, 33])] + cut()) for i in range(80)] + [(100 + i, hot[8:31] + cut() * 2) for i in range(20)] + [(200 + i, t) for i, t in enumerate(["small gram one " * 2, "small gram one " * 2, hot])]
    for length in (16, 24):
        got = {x.doc_id: [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)] for x in repeated_spans.remove_repeats(frame(spark, rows), length).collect()}
        assert got == repeats([(i, t.encode()) for i, t in rows], length)
    assert min(divided) > 4


def test_repeats_of_400_bytes_equal_brute_force(spark):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [text(n) for n in (399, 400, 401, 650, 1500)]
    rows = [(i, text(r.randrange(300)) + r.choice(passages)[r.choice([0, 0, 1, 3]) :] + text(r.randrange(300))) for i in range(60)]
    rows += [(100 + i, passages[4][: 700 + i] + "x" + passages[4][700 + i :]) for i in range(20)] + [(200, "ab" * 700), (201, passages[3] * 2), (202, text(5000)), (203, passages[1]), (204, passages[0])]
    got = {x.doc_id: [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)] for x in repeated_spans.remove_repeats(frame(spark, rows)).collect()}
    assert got == repeats([(i, t.encode()) for i, t in rows], 400)


def test_a_task_sorts_bounded_blocks(monkeypatch):
    monkeypatch.setattr(repeated_spans, "BLOCK", 3)
    sizes, inner = [], repeated_spans.repeated_windows
    monkeypatch.setattr(repeated_spans, "repeated_windows", lambda group, *a: sizes.append(len(group)) or inner(group, *a))
    rows = [{"gram": g, "ctx": b"%d %d" % (g, i), "left": 8, "context": b"%d" % i + b"%07d" % g + b"x" * 16, "held": 1} for g in range(6) for i in range(2)]
    out = list(repeated_spans._resolved(iter([pa.RecordBatch.from_pylist(rows)]), 16))
    assert max(sizes) <= 4
    assert sum(sizes) == 12
    assert sum(len(b) for b in out) == 12


def test_suffixes_survive_hash_collisions(monkeypatch):
    texts = np.frombuffer(b"abcdabceabcdzzzz", dtype=np.uint8).reshape(4, 4)
    s = repeated_spans.Suffixes(np.zeros(4, dtype=np.int64), texts, np.full(4, 4))
    s.prefix[:] = 0  # every prefix collides
    order, common = s.sorted_with_common()
    assert [bytes(texts[i]) for i in order] == [b"abcd", b"abcd", b"abce", b"zzzz"]
    assert common.tolist() == [-1, 4, 3, 0]


def test_repeats_of_an_empty_table(spark):
    assert repeated_spans.remove_repeats(frame(spark, []).limit(0)).count() == 0


def base_rules(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked), failed


def test_quality_rules(spark):
    rows = family(30, 9) + [(900, "spam " * 200), (901, "a b\na b\n\n \na b"), (902, "Ünïcode # $ | < é" * 9), (903, "x " * 19 + "y")]
    rows += [(1000 + i, " ".join(random.Random(i).choice(WORDS[:6] + ["rare" + str(i)]) for _ in range(120))) for i in range(30)] + [(2000, "|".join("zq*%" + str(i) for i in range(50)) + " ### %% $$$ &&&" * 60)]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(t), (i, t)
        assert not (r.kept and r.base_failed)
    assert not got[2000].kept
    assert all(got[1000 + i].kept or got[1000 + i].base_failed for i in range(30))
    assert quality_rules.judge(frame(spark, []).limit(0)).count() == 0


def test_divergence_catches_junk_and_keeps_clean_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    seen = quality_rules.judge(docs).join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("n_words >= 80").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, seen))
    assert share[1] > 0.99
    assert share[0] < 0.35


def plain_shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_containment_equals_brute_force(spark):
    r = random.Random(2)
    items = [(i, " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))) for i, n in enumerate([4, 5, 6, 12, 30, 55])] + [(90, None), (91, "")]
    docs = [(i, t) for i, t in family(30, 4)]
    for j, (_, t) in enumerate(items[:6]):
        w = t.split()
        docs.append((700 + j, "Before. " + " ".join(w).upper() + ", after " + "filler " * (900 * (j % 2))))
        w[len(w) // 2] = "other"
        docs.append((800 + j, "x " + " ".join(w)))
    docs += [(None, items[4][1]), (700, "again")]
    want = {(d, i) for d, t in docs for i, s in items if d is not None and plain_shingles(s) and 100 * len(plain_shingles(s) & plain_shingles(t)) >= 80 * len(plain_shingles(s))}
    got = decontamination.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert len(want) >= 5
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(frame(spark, docs), nothing).count() == 0
    assert decontamination.contained_items(frame(spark, []).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_shards(spark):
    rows = family(90, 8) + [(600 + i, "the same copy of a text " * 9) for i in range(120)] + [(None, "x")]
    got = sharding.shard(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by_id = {i: t for i, t in rows}
    assert all(r.size == len((by_id[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((by_id[r.doc_id] or "").encode()) for r in got)
    largest = max(len((t or "").encode()) for _, t in rows)
    assert max(size.values()) - sum(size.values()) / 8 <= largest + sum(size.values()) / 64
    assert sharding.shard(frame(spark, []).limit(0)).count() == 0


def test_shards_of_a_whole_table_are_near_equal(spark):
    got = sharding.shard(table(spark, "/root/testdata/sf0.1", "documents")).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    total = sum(r.b for r in got)
    assert len(got) == 8
    assert all(abs(r.b * 8 / total - 1) < 0.03 for r in got)


def test_ranges_of_the_mix_hold_few_rows_whatever_the_weights(spark):
    """Nearly all rows of one source and of a small weight: no range of keys holds many times its share."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("two words").alias("text"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        seen, real = [], common.discard

        def watch(*frames):
            for f in frames:
                if "range_no" in f.columns:
                    seen.append(f.groupBy("range_no").count().agg(F.max("count")).first()[0])
            real(*frames)

        common.discard = watch
        out = mixing.mix(docs, docs.where("doc_id % 50 > 0").select("doc_id", F.lit(0.25).alias("weight"))).agg(F.count("*"), F.sum("taken"), F.min("taken")).first()
    finally:
        common.discard = real
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert out[0] == 40_000 and out[1] == 80_000 and out[2] == 2
    assert seen and seen[0] < 3 * 1000


def test_a_language_of_few_repeated_ids_is_learnt(spark):
    rows = spark.range(20_000).select(F.lit(8).cast("bigint").alias("doc_id"), F.lit("hola que tal").alias("text"), F.lit("es").alias("lang"))
    other = spark.range(300).select("id", F.lit("the house of words").alias("text"), F.lit("en").alias("lang"))
    langs, _ = language_id.fit(rows.unionAll(other), rounds=1)
    assert langs == ["en", "es"]
    with pytest.raises(ValueError, match="more than 1 languages"):
        language_id.fit(rows.unionAll(other), most_languages=1)


def test_mix(spark):
    rows = [(i, "w " * (5 + i % 9), "en", f"s{min(i % 11, 4)}" if i % 13 else None, "") for i in range(400)] + [(900, None, "en", "s0", ""), (901, "", "en", "tiny", ""), (902, "one", "en", "tiny", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, spark.createDataFrame([(1, 2.0), (2, 0.25)], "doc_id long, weight double")).collect()
    again = mixing.mix(docs, spark.createDataFrame([(1, 2.0), (2, 0.25)], "doc_id long, weight double")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r[0]: r[3] for r in rows}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s, t in target.items():
        assert t <= 3 * size[s] + 1e-6
        assert abs(taken[s] - t) <= 14
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free = [s for s in names if target[s] < 3 * size[s] - 1e-6]
    assert len({round(target[s] / weight[s], 6) for s in free}) == 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_quality_votes(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = quality_classifier.op4_neighbour_votes(spark, d).join(labels, "doc_id").where("held_out").groupBy("quality").agg(F.avg("predicted")).collect()
    share = dict(map(tuple, got))
    assert share[1] > 0.98
    assert share[0] < 0.4
    model = quality_classifier.fit(docs, labels, sample=200)
    edge = quality_classifier.score(frame(spark, [(1, None), (2, ""), (None, "ab"), (3, "word " * 30000)]), model, ["doc_id", "sig"]).collect()
    assert len(edge) == 4
    assert all(0 <= r.score <= 1 for r in edge)
    assert edge[0].score == pytest.approx(model.base)
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(frame(spark, [(1, "x y z")]), none, ["doc_id"]).collect()} == {0.5}


def test_votes_equal_brute_force():
    r = np.random.default_rng(0)
    v = quality_classifier.unit(r.normal(size=(50, 6)).astype(np.float32))
    m = quality_classifier.Model(np.ones(4), np.ones((4, 6)), v, (r.random(50) < 0.6).astype(np.float32), 0.6, 7, 2.0)
    x = quality_classifier.unit(r.normal(size=(9, 6)).astype(np.float32))
    for got, row in zip(quality_classifier.votes(m, x), x, strict=True):
        near = sorted(((float(row @ n), float(y)) for n, y in zip(v, m.labels, strict=True)), reverse=True)[:7]
        weight = [max(s, 0) ** 2 for s, _ in near]
        assert got == pytest.approx(sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight), abs=1e-5)


def test_forward_sums_all_segmentations():
    vocab = language_id.vocabulary(language_id.VOCABULARY)
    r = np.random.default_rng(1)
    probs = r.random((len(vocab.pieces), 2)) / 1000
    at = {p: i for i, p in enumerate(vocab.pieces)}
    text = b"the cat \xc3\xa9t\xc3\xa9 xyzzy"
    buf = np.frombuffer(text, dtype=np.uint8)
    spans = [(m.start(), m.end()) for m in re.finditer(rb"\S+", text)]
    got = language_id.log_likelihoods(vocab, probs, buf, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    for (a, b), row in zip(spans, got, strict=True):
        word = b" " + text[a:b]
        total = np.zeros(2)
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(word)), n) for n in range(len(word))):
            ends = [0, *cuts, len(word)]
            pieces = [word[x:y] for x, y in zip(ends, ends[1:], strict=False)]
            if all(p in at for p in pieces):
                total += np.prod([probs[at[p]] for p in pieces], axis=0)
        assert row == pytest.approx(np.log(total), rel=1e-6)


def test_long_words_are_summed_whole():
    """Every segmentation of words of up to 400 bytes, against sums of exact fractions."""
    from fractions import Fraction

    vocab = language_id.vocabulary(language_id.VOCABULARY)
    r = np.random.default_rng(2)
    probs = r.integers(1, 1000, (len(vocab.pieces), 2)) / 100000
    at = {p: i for i, p in enumerate(vocab.pieces)}
    longest = max(map(len, vocab.pieces))
    assert longest > 12
    words = [b"donaudampfschifffahrtsgesellschaftskapitaenswitwenrentenantrag", "文字の切れ目がない言葉は長くなるので分けずに全部を足す".encode(), b"x" * 400, b"a" * 31, b"b" * 32, max(vocab.pieces, key=len).strip() * 2]
    text = b" ".join(words)
    buf = np.frombuffer(text, dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    got = language_id.log_likelihoods(vocab, probs, buf, starts, ends)
    for word, row in zip(words, got, strict=True):
        spaced = b" " + word
        for k in range(2):
            sums = [Fraction(1)]
            for j in range(1, len(spaced) + 1):
                sums.append(sum((sums[i] * Fraction(float(probs[at[spaced[i:j]], k])) for i in range(max(0, j - longest), j) if spaced[i:j] in at), Fraction(0)))
            want = sums[-1].numerator
            assert row[k] == pytest.approx(np.log(want / (1 << want.bit_length())) + (want.bit_length() - sums[-1].denominator.bit_length()) * np.log(2) - np.log(sums[-1].denominator / (1 << sums[-1].denominator.bit_length())), rel=1e-9)


def test_long_and_short_words_have_the_same_expected_counts(monkeypatch):
    vocab = language_id.Vocabulary({b" a", b"ab", b"abc", b"bc", b"cab"})
    probs = np.random.default_rng(3).random((len(vocab.pieces), 1)) / 10
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "x"], "word": ["abcab", "cabbc"], "n": [2, 3]})

    class Sent:
        def __init__(self, value):
            self.value = value

    each = []
    for limit in (32, 1):
        monkeypatch.setattr(language_id, "LONG", limit)
        out = next(language_id._expected(iter([batch]), Sent(vocab), ["x"], Sent(probs)))
        each.append(dict(zip(out["piece"].to_pylist(), out["count"].to_pylist(), strict=True)))
    assert each[0] == pytest.approx(each[1])


def test_language_id(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(docs, sample=60)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    share = got.where("fold").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97
    edge = {r.doc_id: r for r in language_id.identify(frame(spark, [(1, None), (2, "12 34 !!"), (3, "the and of that"), (4, "x" * 5000), (5, "")]), model).collect()}
    assert edge[1].lang_pred == edge[2].lang_pred == edge[5].lang_pred == "und"
    assert edge[3].lang_pred == "en"
    assert edge[4].lang_pred in model[0]
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(frame(spark, [(1, "abc")]), none).collect()} == {"und"}


def test_placement_equals_brute_force(spark):
    """Draws, cuts, ranges, pieces, shards and slots recomputed row by row."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    whole = lambda v, seed: xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed & (2**64 - 1))
    rows = family(200, 12) + [(600 + i, "the same copy of a text " * 9) for i in range(150)] + [(None, "x"), (7, "again")]
    got = Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard(frame(spark, rows)).collect())
    made = []
    for i, t in rows:
        data = (t or "").encode()
        key = signed(xxhash.xxh64_intdigest(data, 42))
        # A null leaves the seed as it is, which is what hashing nothing but a null gives.
        draw = signed(whole(i, 42)) if i is not None else 42
        u = xxhash.xxh64_intdigest(b"draw", whole(draw, whole(key, 42)))
        made.append({"id": i, "size": len(data) + 1, "crc": zlib.crc32(data), "key": key, "draw": draw, "u": (u >> 11) / 2.0**53})
    total = sum(m["size"] for m in made)
    keys = np.sort(np.array([m["key"] for m in made if m["u"] < m["size"] * (8 * 64 * 16 / total)], dtype=np.int64))
    cuts = np.unique(keys[15::16])
    fill = max(1, total // 512)
    ranges = {}
    for m in made:
        ranges.setdefault(int(np.searchsorted(cuts, m["key"], "right")), []).append(m)
    pieces = {}
    for at, members in ranges.items():
        held = sum(m["size"] for m in members)
        n = min(len(members), held // fill) if held > 2 * fill else 1
        for m in members:
            pieces.setdefault((at, signed(xxhash.xxh64_intdigest((m["draw"] & (2**64 - 1)).to_bytes(8, "little"), 42)) % n), []).append(m)
    want, ahead, offset = Counter(), 0, Counter()
    for at in sorted(pieces):
        members = sorted(pieces[at], key=lambda m: (m["key"], m["id"] is not None, m["id"] or 0))
        held = sum(m["size"] for m in members)
        shard = min(int((ahead + held / 2) / (total / 8)), 7)
        for m in members:
            want[m["id"], m["size"], m["crc"], shard, offset[shard]] += 1
            offset[shard] += 1
        ahead += held
    assert got == want

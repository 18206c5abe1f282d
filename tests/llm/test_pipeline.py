"""The pipeline's stages take effect, keep what they must, and equal brute force end to end."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from ledgerlark.llm import quality_classifier
from ledgerlark.session import table
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, copies int, quality_score double, `_id` long, component_id long, best string"


def test_stages_take_effect(spark):
    docs = table(spark, D, "documents")
    seen = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, seen, D)
        assert out.columns == docs.columns, name
        rows = out.cache()
        assert rows.exceptAll(seen).count() == 0, name
        counts.append(rows.count())
        seen = rows
    assert docs.count() > counts[0] > counts[1] >= counts[2] > 0
    mixed = corpus_pipeline.mix_sources(spark, seen, D).cache()
    assert mixed.columns == docs.columns
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    out = corpus_pipeline.deal_shards(spark, mixed, D)
    assert out.count() == mixed.count()


def test_near_duplicates_and_leaks_go(spark):
    text = " ".join(f"w{i}" for i in range(200))
    item = table(spark, D, "benchmark").first().text
    rows = [(1, text), (2, text.replace("w100", "x")), (3, "another text of its own " + " ".join(f"v{i}" for i in range(60))), (None, text), (None, "y " + item), (4, "start " + item + " end"), (5, None), (5, None), (5, "fifth " * 9), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], table(spark, D, "documents").schema)
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    assert ids(corpus_pipeline.keep_one_of_each_group(spark, docs, D)) == [1, 3, 4, 5, 5, 6]
    assert ids(corpus_pipeline.drop_leaks(spark, docs, D)) == [0, 1, 2, 3, 5, 5, 5, 6]
    mixed = corpus_pipeline.mix_sources(spark, docs, D).collect()
    assert max(Counter((r.doc_id, r.text) for r in mixed).values()) <= 6


def test_empty_documents(spark):
    none = table(spark, D, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, D).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, pattern):
    w = re.findall(pattern, text or "")
    return {tuple(w)} if 0 < len(w) < 5 and pattern.startswith("[^\\x20") else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def grouped(rows):
    """One row of each group of texts of a similarity of 0.8 or more, smallest id first, rows without one last."""
    rows = list(dict.fromkeys(rows))
    sets = [shingles(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""), r"[^\x20\x09-\x0D]+") for _, t, _ in rows]
    left, out = set(range(len(rows))), []
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            near = {j for j in left if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
            left -= near
            todo += near
        out.append(min((rows[i] for i in group), key=lambda r: (r[0] is None, r[0] or 0)))
    return out


def mixed(rows, weights):
    """Rows as often as the mix takes them, by the definition of targets and keys."""
    size, by = Counter(), defaultdict(list)
    for i, t, s in rows:
        size[s] += len(words(t))
        u = (int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 1) / ((1 << 48) + 1)
        by[s].append((-math.log(u) / weights.get(i, 1.0), -1 if i is None else i, len(words(t)), (i, t, s)))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 3 * size[s]}
        if not full:
            break
        target |= {s: 3.0 * size[s] for s in full}
        open_ -= full
        if not open_:
            break
    target |= {s: level * weight[s] for s in open_}
    out = []
    for s, docs in by.items():
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, run = target[s] - epochs * size[s], 0
        for _, _, n, row in sorted(docs, key=lambda x: x[:3]):
            out += [row] * (epochs + (1 if run + n / 2 <= rest and n > 0 and epochs < 3 else 0))
            run += n
    return out


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows and ids, and columns whose names clash."""
    r = random.Random(5)
    good = lambda n: " ".join(r.choice(["the", "and", "of"]) + r.choice("abcdefgh") * r.randrange(1, 4) + str(r.randrange(30)) for _ in range(n))
    items = [good(n) for n in (6, 20, 40)]
    texts = [good(r.choice([8, 60, 90])) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100 + i, texts[i].replace(texts[i].split()[3], "changed", 1)) for i in range(30)] + [(200 + i, f"{texts[40 + i]} {items[i]} {good(9)}") for i in range(3)]
    rows += [(300 + i, " ".join(r.choice(["$$$", "###", "!!!", "***"]) * r.randrange(1, 5) for _ in range(60))) for i in range(20)]
    rows += [(None, texts[5]), (None, f"null {items[2]}"), (None, good(50)), (7, texts[7]), (7, good(70)), (400, None), (400, None), (401, ""), (402, "one"), (403, "A b"), (404, "a B"), (405, good(9000))]
    docs = [(i, t, "en", ("s0", "s1", "tiny", None)[0 if k < 3 else 1 if k == 3 else 3 if i and i % 2 else 2], 0, "clash", 7, 0.1, 5, 6, "b") for i, t in rows for k in [len(t or "") % 5]]
    folder = tmp_path_factory.mktemp("fixture")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0 if 300 <= i < 320 else 1, 0) for i in range(420) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), [(d[0], d[1], d[3]) for d in docs], items


def test_run_equals_brute_force(spark, fixture):
    folder, rows, items = fixture
    docs = table(spark, folder, "documents")
    model = quality_classifier.fit(docs, table(spark, folder, "labels"))
    kept = []
    for row in rows:
        data = np.frombuffer((row[1] or "").encode(), dtype=np.uint8)
        x = quality_classifier.unit(quality_classifier.unit(np.log1p(quality_classifier.hashed_counts(data, np.array([0, len(data)]), len(model.idf))) * model.idf) @ model.axes)[0]
        near = sorted(((-float(np.float32(x @ v)), k) for k, v in enumerate(model.vectors)))[: model.neighbours]
        weight = [(min(max(-s, 0), 1) ** model.sharpness, model.labels[k]) for s, k in near]
        total = sum(w for w, _ in weight)
        if (sum(w * y for w, y in weight) / total if total > 1e-9 else model.base) >= quality_classifier.ACCEPTED:
            kept.append(row)
    assert len(rows) - 25 < len(kept) < len(rows)
    kept = grouped(kept)
    plain = r"[^\W_]+"
    leaks = [shingles(t.lower(), plain) for t in items]
    kept = [row for row in kept if not any(s and 5 * len(s & shingles((row[1] or "").lower(), plain)) >= 4 * len(s) for s in leaks)]
    weights = {r.doc_id: 2.0 if r.quality else 0.25 for r in table(spark, folder, "labels").collect()}
    want = mixed(kept, weights)
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, folder).cache()
        assert seen.columns == docs.columns
    order = lambda xs: sorted(Counter(xs).items(), key=repr)
    assert order((r.doc_id, r.text, r.source) for r in seen.collect()) == order(want)
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t, _ in want)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_scores_do_not_depend_on_the_order_of_rows(spark, fixture):
    folder, _, _ = fixture
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    once = quality_classifier.fit(docs, labels)
    again = quality_classifier.fit(docs.repartition(7, F.rand(3)), labels.repartition(5, F.rand(4)))
    for name in ("idf", "axes", "vectors", "labels"):
        assert np.array_equal(getattr(once, name), getattr(again, name)), name


def test_equally_near_labels_count_in_order():
    v = quality_classifier.unit(np.ones((6, 3), dtype=np.float32))
    m = quality_classifier.Model(np.ones(4), np.ones((4, 3)), v, np.array([1, 1, 0, 0, 0, 0], dtype=np.float32), 0.3, 2, 1.0)
    assert quality_classifier.votes(m, v[:1]).tolist() == [1.0]

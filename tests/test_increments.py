"""The incremental index against a dictionary of what it should hold."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from test_operators import hierarchy

from ledgerlark.sources.increments import DocumentIndex, next_version

FORM = "id long, version string, text string"


def normal(text):
    return "\n".join(line.rstrip(" \t") for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")).strip()


def blocked(text):
    return any(w in text.lower() for w in ("ignore previous instructions", "system prompt", "api_key=", "bearer "))


def following(version):
    return str(int(version) + 1) if version.isdigit() else f"{version}.1"


def moved(held, last, docs, whole=True):
    """The index (id -> version, text) after an update, and what changed."""
    out, changes = dict(held), {}
    for key, version, text in docs:
        text = normal(text)
        if blocked(text):
            changes[key] = "blocked"
        elif key not in held or held[key][1] != text:
            changes[key] = "changed" if key in held else "added"
            out[key] = (following(last[key]) if key in last else version or "1", text)
            last[key] = out[key][0]
    for key in set(held) - {d[0] for d in docs} if whole else ():
        changes[key] = "gone"
        del out[key]
    return out, changes


def indexed(held):
    out = {}
    for key, (version, text) in held.items():
        chunks = [c[-1] for c in hierarchy(key, version, text)]
        told = json.dumps({"document_id": str(key), "version": version, "chunks": chunks}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        out[key] = (version, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()[:24], len(chunks))
    return out


def test_updates_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(11)
    pool = [None, "", "  \n", "a b c", "a b c  \r\n", "# h\nx y\n# i\nz", "api_key=1", "Bearer x", "评论 好", "w " * 800, "# only"]
    index, held, last, past = DocumentIndex(spark, str(tmp_path / "index")), {}, {}, {}
    for turn in range(5):
        docs = [(i, rng.choice([None, "3", "a"]), rng.choice(pool)) for i in range(40) if rng.random() < 0.7]
        docs += [(99, "0", str(turn))]
        whole = turn != 2
        frame = spark.createDataFrame(docs, FORM).repartition(1 + turn)
        dry = index.update(frame, dry_run=True, whole=whole)
        assert len(index.states()) == turn  # a dry run publishes nothing
        held, changes = moved(held, last, docs, whole)
        told = index.update(frame, whole=whole)
        assert dry | {"state": None} == told | {"state": None} and dry["state"] is None
        assert {r.id: r.change for r in index.changes().collect()} == changes
        assert {r.id: (r.version, r.hash, r.index_version, r.n_chunks) for r in index.documents().collect()} == indexed(held)
        want = {(i, *c[:3], c[-1]) for i, (v, t) in held.items() for c in hierarchy(i, v, t)}
        assert {(r.id, r.nth, r.heading, r.n_tokens, r.chunk_id) for r in index.chunks().collect()} == want
        index.verify()
        past[told["state"]] = (indexed(held), told["fingerprint"])
    for number, (want, fingerprint) in past.items():  # all old states stay readable
        assert {r.id: (r.version, r.hash, r.index_version, r.n_chunks) for r in index.documents(number).collect()} == want
        assert index.fingerprint(number) == fingerprint
    kept = index.fingerprint()
    index.compact()
    index.verify()
    assert index.fingerprint() == kept and len(index.state()["layers"]) == 1
    assert index.rollback(2) == 7
    index.verify()
    assert index.fingerprint() == past[2][1] != kept
    assert index.summary().first().fingerprint == index.fingerprint()


def test_one_changed_document_rewrites_only_its_chunks(spark, tmp_path):
    docs = [(i, None, f"text {i} " * 300) for i in range(50)]
    index = DocumentIndex(spark, str(tmp_path / "index"))
    index.update(spark.createDataFrame(docs, FORM))
    docs[7] = (7, None, "# new\n" + "other " * 300)
    told = index.update(spark.createDataFrame(docs, FORM))
    written = spark.read.parquet(str(tmp_path / "index" / "c-2"))
    assert [r.id for r in written.select("id").distinct().collect()] == [7] and written.count() == 2
    assert (told["added"], told["changed"], told["gone"]) == (0, 1, 0)
    again = index.update(spark.createDataFrame(docs, FORM))
    assert again["state"] == told["state"] == index.states()[-1]  # nothing to do, nothing published
    other = DocumentIndex(spark, str(tmp_path / "other"))
    frame = spark.createDataFrame(docs, FORM).withColumn("version", F.when(F.col("id") == 7, "2").otherwise("1"))
    assert other.update(frame.repartition(7))["fingerprint"] == told["fingerprint"]  # same documents, another way there


def test_a_first_load_works_on_each_text_a_few_times_only(spark, tmp_path):
    index = DocumentIndex(spark, str(tmp_path / "index"))
    docs = spark.createDataFrame([(1, "x", "a \n# b\nc")], FORM)
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plan = index.plan(docs)
    for told, times in ((text(plan), 2), (text(index._pieces(docs, plan)), 1)):  # for hash and scan; once for the chunks
        assert 1 <= told.count("(?m)[ \\t]+$") <= times and told.count("lower(") == 1
    assert [r.content for r in index._pieces(docs, plan).orderBy("nth").collect()] == ["a", "c"]
    index.update(docs)
    changed = spark.createDataFrame([(1, "changed", "x.1")], "id long, change string, version string")
    again = index._pieces(docs, changed)
    assert text(again).count("(?m)[ \\t]+$") == 1 and [r.content for r in again.orderBy("nth").collect()] == ["a", "c"]


def test_edges_of_an_index(spark, tmp_path):
    index = DocumentIndex(spark, str(tmp_path / "index"))
    docs = spark.createDataFrame([(1, "x", "a")], FORM)
    for bad in (docs.unionByName(docs), docs.withColumn("id", F.lit(None).cast("long"))):
        with pytest.raises(ValueError, match="unique"):
            index.update(bad)
    for call in (index.documents, index.chunks, index.rollback, index.compact):
        with pytest.raises(ValueError):
            call()
    assert index.update(docs.limit(0))["state"] is None  # an empty table, an empty index
    assert index.update(docs.withColumn("nth", F.lit(1)).withColumn("hash", F.lit("h")).drop("version"))["documents"] == 1
    assert index.documents().first().version == "1"
    assert index.update(docs.limit(0), whole=False)["gone"] == 0
    assert index.update(docs.limit(0))["gone"] == 1 and index.documents().count() == 0 and index.chunks().count() == 0
    assert index.state()["sums"] == ["0"] * 4
    index.rollback()
    assert index.documents().count() == 1
    with pytest.raises(ValueError, match="not found"):
        index.documents(77)
    row = spark.range(1).select(*(next_version(F.lit(v)) for v in ("007", "9", "1.0", "", "1\n"))).first()
    assert list(row) == ["8", "10", "1.0.1", ".1", "1\n.1"]


def test_a_damaged_index_is_found(spark, tmp_path):
    index = DocumentIndex(spark, str(tmp_path / "index"))
    index.update(spark.createDataFrame([(i, None, f"text {i}") for i in range(9)], FORM))
    index.verify()
    chunks = spark.read.parquet(str(tmp_path / "index" / "c-1"))
    chunks.where("id <> 4").write.parquet(str(tmp_path / "less"))
    spark.read.parquet(str(tmp_path / "less")).write.mode("overwrite").parquet(str(tmp_path / "index" / "c-1"))
    with pytest.raises(ValueError, match="doesn't hold"):
        index.verify()

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import retrieval as V


@pytest.fixture
def uncoalesced(spark):
    """Small shuffles keep all their partitions, as large ones do."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_blocks_of_queries_and_documents_meet_in_one_partition(spark, uncoalesced):
    made = lambda key: spark.createDataFrame([(i, float(i)) for i in range(40)], f"{key} long, x double")
    near = lambda q, d: -np.abs(q["x"].to_numpy()[:, None] - d["x"].to_numpy()[None, :])
    got = V.blocked_topk(made("query_id"), made("id"), 1, near, query_rows=8, doc_rows=8).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(i, i) for i in range(40)]


def test_searches_by_blocks_equal_joined_scores(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 13}" for j in range(i % 9))) for i in range(60)] + [(60, None), (61, "W1 w1  w2")], "id long, text string")
    asked = spark.createDataFrame([(0, "w1 w2 w2 w7"), (1, "w12"), (2, ""), (3, "nowhere w0 w0")], "query_id long, text string")
    rows = lambda df: sorted((r.query_id, r.id, r.score, r.rank) for r in df.collect())
    for search, score in ((V.keyword_search, V.keyword_score), (V.cosine_search, V.token_cosine), (V.bm25_search, V.bm25), (V.char_tfidf_search, V.char_tfidf)):
        want = rows(V.ranked(score(asked, docs), 5))
        assert want
        assert rows(search(asked, docs, 5)) == want
    odd = F.col("id") % 2 == 1
    assert rows(V.bm25_search(asked, docs, 3, where=odd)) == rows(V.ranked(V.bm25(asked, docs, where=odd), 3))
    assert rows(V.char_tfidf_search(asked, docs, 5, most_grams=2)) == rows(V.char_tfidf_search(asked, docs, 5))


def test_searches_join_no_pairs(spark, sf):
    from ledgerlark.plans import registry

    for name in ("r01_keyword", "r03_token_cosine", "r10_bm25", "r10_bm25_filtered", "r11_char_tfidf"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        top = plan[: plan.index("CoGroup")]
        assert "Join" not in top, name


def test_windows_of_a_batch_stay_within_their_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "e f"), (4, "g a b c a b c")], "id long, text string").coalesce(1)
    asked = spark.createDataFrame([(0, "a b c x a b c"), (1, "d e f"), (2, ""), (3, "c b a"), (4, "g a b")], "query_id long, text string").coalesce(1)
    got = {r.query_id: (r.windows, r.shared, r.overlap) for r in V.window_overlap(asked, docs, 3).collect()}
    assert got == {0: (4, 1, 0.25), 1: (1, 0, 0.0), 2: (0, 0, 0.0), 3: (1, 0, 0.0), 4: (1, 1, 1.0)}
    assert {(r.query_id, r.id) for r in V.holders(asked, docs, 3, 100).collect()} == {(4, 4)}
    assert "zip_with" not in V.window_overlap(asked, docs, 3)._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_characters_are_distinct_before_they_are_trimmed(spark):
    from ledgerlark.operators import workflow as W

    df = spark.createDataFrame([("Ab aB b",), ("x",), (None,)], "text string").select(W.bigram_tokens(F.col("text")).alias("t"))
    assert [sorted(r.t) for r in df.collect()] == [["ab"], [], []]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 2


def test_scores_of_hits_are_rounded_half_up_by_both_sides(spark):
    import duckdb

    hits = spark.createDataFrame([(0, 1, 1, 0.33945)], "query_id long, id long, rank int, score double")
    cases = spark.createDataFrame([(1, "x", 7)], "id long, text string, product long")
    told = V.retrieved(hits, cases, "tfidf").first().score
    assert told == duckdb.sql("SELECT CAST(round(CAST(CAST(0.33945 AS DOUBLE) AS DECIMAL(9,6)), 4) AS DOUBLE)").fetchall()[0][0] == 0.3395

"""Reporting, indicator and evaluation queries with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.operators import reporting as R
from ledgerlark.plans.views import ANA, AS_OF_EVENTS, LIN, ORD, RUN, analyses, lines, orders, runs
from ledgerlark.session import table

DAY = "2024-01-31"


def _log(s, d):  # noqa: ANN001, ANN202
    """Searches: every view event, finding as many cases as its k."""
    found = F.regexp_extract("props", r'"k": (\d+)', 1).cast("int") % 4
    return runs(s, d).where("tool = 'view'").select("id", "duration_ms", "created", found.alias("found"))


def _feedback(s, d):  # noqa: ANN001, ANN202
    """Feedback on labelled documents."""
    return table(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "false_positive").when(F.col("quality") == 1, "accept").otherwise("reject").alias("feedback_type"))


def _tasks(s, d):  # noqa: ANN001, ANN202
    return orders(s, d).select("id", F.when(F.col("status") == 101, "pending").otherwise("closed").alias("status"))


FEED = "feed AS (SELECT CASE WHEN toxic = 1 THEN 'false_positive' WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS kind FROM labels)"
LOG = "log AS (SELECT id, duration_ms, created, CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS INTEGER) % 4 AS found FROM run WHERE tool = 'view')"


def _routes(s, d):  # noqa: ANN001, ANN202
    """Routing decisions: labelled documents, high risk when toxic, predicted from the id."""
    return table(s, d, "labels").select((F.col("quality") == 0).alias("expected"), (F.col("doc_id") % 3 == 0).alias("predicted"), (F.col("toxic") == 1).alias("high"))


def _classes(s, d):  # noqa: ANN001, ANN202
    return analyses(s, d).where("label is not null").select(F.col("label").alias("truth"), F.expr("case when id % 4 = 0 then 'neutral' when id % 7 = 0 then 'mixed' else label end").alias("said"))


QUERIES = {
    "a01_daily_users": lambda s, d: R.daily_users(orders(s, d).select("day", F.col("user_id").alias("id"))),
    "a02_daily_orders": lambda s, d: R.daily_orders(orders(s, d)),
    "a03_daily_goods": lambda s, d: R.daily_goods(lines(s, d)),
    "a04_analysis_summary": lambda s, d: R.analysis_summary(analyses(s, d), DAY),
    "a05_sentiment_dist": lambda s, d: R.distribution(analyses(s, d).where("not deleted"), "label"),
    "a06_risk_trend": lambda s, d: R.risk_trend(analyses(s, d), DAY),
    "a07_risk_type_dist": lambda s, d: R.risk_types(analyses(s, d)),
    "a08_top_risk_products": lambda s, d: R.top_risky_products(analyses(s, d)),
    "a09_status_stats": lambda s, d: R.distribution(orders(s, d).where("not deleted"), "status"),
    "a10_case_stats": lambda s, d: R.distribution(analyses(s, d).where("not deleted").withColumn("level", F.expr("case when label = 'negative' then 'high' when confidence < 0.6 then 'medium' else 'low' end")), "level"),
    "a11_retrieval_summary": lambda s, d: R.retrieval_summary(_log(s, d)),
    "a12_eval_summary": lambda s, d: R.evaluation_summary(runs(s, d)),
    "a12_duplicate_groups": lambda s, d: R.repeated_groups(runs(s, d).where("status = 'success'"), ["user_id", "tool"]),
    "a12_feedback_stats": lambda s, d: R.feedback_stats(_feedback(s, d)),
    "a12_eval_scalars": lambda s, d: R.evaluation_scalars(runs(s, d).where("not is_replay"), runs(s, d), _feedback(s, d), analyses(s, d).select(F.col("label").alias("source_type"), (F.col("id") % 90).alias("source_id")), _tasks(s, d)),
    "a13_eval_trend": lambda s, d: R.eval_trend(runs(s, d), AS_OF_EVENTS),
    "a13_search_trend": lambda s, d: R.search_trend(_log(s, d), AS_OF_EVENTS),
    "a13_ops_trend": lambda s, d: R.run_trend(runs(s, d), AS_OF_EVENTS),
    "a14_tool_stats": lambda s, d: R.tool_stats(runs(s, d)),
    "a15_steps_by_role": lambda s, d: R.steps_by_role(runs(s, d)),
    "a16_run_detail": lambda s, d: R.run_details(runs(s, d)),
    "a17_quality_summary": lambda s, d: R.quality_summary(runs(s, d)),
    "a18_failure_groups": lambda s, d: R.failure_groups(runs(s, d)),
    "a19_ops_summary": lambda s, d: R.ops_summary(runs(s, d)),
    "a23_memory_profile_goods": lambda s, d: R.memory_profile(analyses(s, d), "product_id"),
    "a24_memory_profile_risk": lambda s, d: R.memory_profile(analyses(s, d).withColumn("risk_type", F.when(F.col("label") == "negative", "negative_review").when(F.col("confidence") < 0.6, "low_confidence").otherwise("none")), "risk_type"),
    "a25_failure_top": lambda s, d: R.top_failures(runs(s, d)),
    "a26_fallback_dist": lambda s, d: R.fallback_split(runs(s, d)),
    "a27_quality_trend": lambda s, d: R.quality_trend(R.run_trend(runs(s, d), AS_OF_EVENTS)),
    "a28_order_tabs": lambda s, d: R.order_tabs(orders(s, d), lines(s, d)),
    "a29_cart_totals": lambda s, d: R.cart_totals(lines(s, d)),
    "a30_totals": lambda s, d: R.totals(users=table(s, d, "customer"), goods=table(s, d, "part"), orders=table(s, d, "orders"), lines=table(s, d, "lineitem")),
    "a31_comment_counts": lambda s, d: R.comment_counts(analyses(s, d)),
    "a32_group_members": lambda s, d: R.members_joined(runs(s, d).select((F.col("id") % 500).alias("group_id"), "user_id"), 20),
    "a33_open_tasks": lambda s, d: R.open_tasks(orders(s, d), [401]),
    "a34_spec_groups": lambda s, d: R.spec_groups(lines(s, d)),
    "a35_coupon_caps": lambda s, d: R.coupon_caps(orders(s, d).select((F.col("id") % 97).alias("coupon_id")), table(s, d, "part").select(F.col("p_partkey").alias("coupon_id"), (F.col("p_partkey") % 5 * 60).alias("total"))),
    "a36_histogram": lambda s, d: R.histogram(runs(s, d), "tool", "duration_ms"),
    "a37_p95_nearest": lambda s, d: R.nearest_rank(runs(s, d), "user_id", "duration_ms"),
    "a38_confusion": lambda s, d: R.confusion(_routes(s, d)),
    "a39_macro_f1": lambda s, d: R.macro_f1(_classes(s, d)),
    "a43_http_counters": lambda s, d: runs(s, d).agg(F.count("*").alias("requests"), F.count(F.when(F.col("status") == "failed", 1)).alias("errors"), F.sum("duration_ms").alias("busy_ms")),
    "a44_agreement": lambda s, d: R.agreement(analyses(s, d).select("id", "label", "rating"), analyses(s, d).select("id", F.expr("case when id % 9 = 0 then 'neutral' else label end").alias("label"), F.expr("cast(1 + id % 5 - id % 2 * (id % 3) as int)").alias("rating")), ["label", "rating"]),
    "a45_divergence": lambda s, d: R.label_divergence(
        analyses(s, d).where("id % 2 = 0").groupBy(F.coalesce("label", F.lit("none")).alias("key")).agg(F.count("*").alias("n")), analyses(s, d).where("id % 2 = 1").groupBy(F.coalesce("label", F.lit("none")).alias("key")).agg(F.count("*").alias("n"))
    ),
    "a46_min_sku_price": lambda s, d: R.least_price(table(s, d, "part").select(F.col("p_partkey").alias("goods_id")), lines(s, d).where("goods_id % 3 = 0").select("goods_id", "price")),
}

_RATE = "CAST(floor({n} * 100.0 / {d} + 0.5) AS BIGINT)"
_RISKY = "(label = 'negative' OR confidence < 0.6)"

ORACLE_SQL = {
    "a01_daily_users": f"WITH {ORD} SELECT day, count(DISTINCT user_id) AS users FROM ord GROUP BY 1",
    "a02_daily_orders": f"""WITH {ORD}, s AS (SELECT day, count(*) AS orders, count(DISTINCT user_id) AS customers, sum(amount) AS amount FROM ord WHERE status IN (401, 402) GROUP BY 1)
        SELECT day, orders, customers, CAST(amount AS DOUBLE) AS amount, CAST((2 * CAST(amount * 100 AS BIGINT) + customers) // (2 * customers) AS DOUBLE) / 100 AS amount_per_customer FROM s""",
    "a03_daily_goods": f"WITH {LIN} SELECT strftime(shipped, '%Y-%m-%d') AS day, count(DISTINCT order_id) AS orders, CAST(sum(number) AS BIGINT) AS pieces, CAST(sum(number * price) AS DOUBLE) AS amount FROM lin GROUP BY 1",
    "a04_analysis_summary": f"""WITH {ANA} SELECT count(*) AS total, count(*) FILTER (day = DATE '{DAY}') AS today, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'neutral') AS neutral,
        count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (confidence < 0.6) AS low_confidence, count(*) FILTER {_RISKY} AS risky,
        round(coalesce(avg(CAST(confidence AS DOUBLE)), 0), 6) AS mean_confidence, max(day) AS latest FROM ana WHERE NOT deleted""",
    "a05_sentiment_dist": f"WITH {ANA} SELECT label, count(*) AS total FROM ana WHERE NOT deleted GROUP BY 1",
    "a06_risk_trend": f"""WITH {ANA} SELECT day, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (confidence < 0.6) AS low_confidence, count(*) AS total
        FROM ana WHERE NOT deleted AND day >= DATE '{DAY}' - 6 GROUP BY 1""",
    "a07_risk_type_dist": f"""WITH {ANA}, live AS (SELECT * FROM ana WHERE NOT deleted)
        SELECT 'negative_review' AS name, count(*) AS total FROM live WHERE label = 'negative' UNION ALL SELECT 'low_confidence', count(*) FROM live WHERE confidence < 0.6
        UNION ALL SELECT 'after_sales_risk', count(*) FROM live WHERE negative_score >= 0.65""",
    "a08_top_risk_products": f"""WITH {ANA} SELECT product_id, count(*) AS total, round(avg(CAST(confidence AS DOUBLE)), 6) AS mean_confidence FROM ana WHERE NOT deleted AND {_RISKY}
        GROUP BY 1 ORDER BY total DESC, product_id DESC LIMIT 5""",
    "a09_status_stats": f"WITH {ORD} SELECT status, count(*) AS total FROM ord WHERE NOT deleted GROUP BY 1",
    "a10_case_stats": f"WITH {ANA} SELECT CASE WHEN label = 'negative' THEN 'high' WHEN confidence < 0.6 THEN 'medium' ELSE 'low' END AS level, count(*) AS total FROM ana WHERE NOT deleted GROUP BY 1",
    "a11_retrieval_summary": f"WITH {RUN}, {LOG} SELECT count(*) AS total, CAST((2 * sum(duration_ms) + count(*)) // (2 * count(*)) AS BIGINT) AS mean_ms, count(*) FILTER (found = 0) AS empty FROM log",
    "a12_eval_summary": f"""WITH {RUN} SELECT count(*) AS runs, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (is_replay) AS replays,
        count(*) FILTER (duration_ms > 100) AS slow, count(DISTINCT user_id) AS users, count(DISTINCT tool) AS tools, min(duration_ms) AS fastest, max(duration_ms) AS slowest, CAST(sum(duration_ms) AS BIGINT) AS busy_ms FROM run""",
    "a12_duplicate_groups": f"WITH {RUN} SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM run WHERE status = 'success' GROUP BY user_id, tool HAVING count(*) > 1)",
    "a12_feedback_stats": f"WITH {FEED} SELECT kind AS name, count(*) AS value FROM feed GROUP BY 1",
    "a12_eval_scalars": f"""WITH {RUN}, {FEED}, {ANA}, n AS (SELECT * FROM run WHERE NOT is_replay) SELECT 'total_runs' AS name, count(*) AS value FROM n UNION ALL SELECT 'success_runs', count(*) FILTER (status = 'success') FROM n UNION ALL SELECT 'failed_runs', count(*) FILTER (status = 'failed') FROM n
        UNION ALL SELECT 'mean_ms', CAST((2 * sum(duration_ms) + count(*)) // (2 * count(*)) AS BIGINT) FROM n UNION ALL SELECT 'tool_failures', count(*) FILTER (status = 'failed') FROM run UNION ALL SELECT 'feedback', count(*) FROM feed UNION ALL SELECT 'accepted', count(*) FILTER (kind = 'accept') FROM feed
        UNION ALL SELECT 'false_positive', count(*) FILTER (kind = 'false_positive') FROM feed UNION ALL SELECT 'duplicate_groups', count(*) FROM (SELECT 1 FROM ana WHERE label IS NOT NULL GROUP BY label, id % 90 HAVING count(*) > 1) UNION ALL SELECT 'pending_tasks', count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) FROM orders""",
    "a13_eval_trend": f"WITH {RUN} SELECT strftime(created, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed FROM run WHERE CAST(created AS DATE) >= DATE '{AS_OF_EVENTS}' - 7 GROUP BY 1",
    "a13_search_trend": f"""WITH {RUN}, {LOG} SELECT strftime(created, '%Y-%m-%d') AS day, count(*) AS queries, count(*) FILTER (found > 0) AS hits, CAST((2 * sum(duration_ms) + count(*)) // (2 * count(*)) AS BIGINT) AS mean_ms, round(100.0 * count(*) FILTER (found > 0) / count(*), 2) AS hit_rate FROM log WHERE CAST(created AS DATE) >= DATE '{AS_OF_EVENTS}' - 7 GROUP BY 1""",
    "a13_ops_trend": f"""WITH {RUN}, t AS (SELECT strftime(created, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (status = 'success') AS success FROM run WHERE CAST(created AS DATE) >= DATE '{AS_OF_EVENTS}' - 7 GROUP BY 1)
        SELECT *, {_RATE.format(n='success', d='total')} AS hit_rate FROM t""",
    "a14_tool_stats": f"""WITH {RUN} SELECT tool, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
        CAST((2 * sum(duration_ms) + count(*)) // (2 * count(*)) AS BIGINT) AS mean_ms FROM run GROUP BY 1""",
    "a15_steps_by_role": f"WITH {RUN} SELECT CASE WHEN role_no = 0 THEN 'Unknown Agent' ELSE 'role-' || role_no END AS role, count(*) AS total FROM run GROUP BY 1",
    "a16_run_detail": f"WITH {RUN} SELECT user_id, count(*) AS steps, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (tool = 'error' OR tool LIKE '%sign%') AS fallbacks FROM run GROUP BY 1",
    "a17_quality_summary": f"""WITH {RUN}, o AS (SELECT count(*) AS n, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (duration_ms <= 100) AS quick, count(*) FILTER (NOT is_replay) AS first FROM run),
        r AS (SELECT {_RATE.format(n='ok', d='n')} AS success_rate, {_RATE.format(n='quick', d='n')} AS quick_rate, {_RATE.format(n='first', d='n')} AS first_rate FROM o)
        SELECT *, least(success_rate, quick_rate, first_rate) < 70 AS warning FROM r""",
    "a18_failure_groups": f"""WITH {RUN} SELECT 'errors' AS name, count(*) AS total FROM run WHERE tool LIKE '%err%' UNION ALL SELECT 'clicks', count(*) FROM run WHERE tool LIKE '%c%'
        UNION ALL SELECT 'none', count(*) FROM run WHERE tool LIKE '%zzz%'""",
    "a19_ops_summary": f"""WITH {RUN}, o AS (SELECT count(*) AS total, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (is_replay) AS fb, sum(duration_ms) AS ms, max(duration_ms) AS mx, quantile_disc(duration_ms, 0.95) AS p FROM run)
        SELECT total, floor(ok * 10000 / total + 0.5) / 100 AS success_percent, floor(fb * 10000 / total + 0.5) / 100 AS fallback_percent, CAST((2 * ms + total) // (2 * total) AS BIGINT) AS mean_ms, mx AS p95_compat, p AS p95 FROM o""",
    "a23_memory_profile_goods": f"""WITH {ANA} SELECT product_id, count(*) AS total, count(*) FILTER (label = 'negative') AS negative, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, max(day) AS latest
        FROM ana WHERE NOT deleted GROUP BY 1""",
    "a24_memory_profile_risk": f"""WITH {ANA} SELECT CASE WHEN label = 'negative' THEN 'negative_review' WHEN confidence < 0.6 THEN 'low_confidence' ELSE 'none' END AS risk_type, count(*) AS total,
        count(*) FILTER (label = 'negative') AS negative, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, max(day) AS latest FROM ana WHERE NOT deleted GROUP BY 1""",
    "a25_failure_top": f"""WITH {RUN} SELECT coalesce(nullif(regexp_extract(props, '"k": (\\d)', 1), ''), 'unknown') AS reason, count(*) AS total FROM run WHERE status = 'failed' GROUP BY 1 ORDER BY total DESC, reason LIMIT 5""",
    "a26_fallback_dist": f"WITH {RUN} SELECT 'fallback' AS name, count(*) FILTER (is_replay) AS total FROM run UNION ALL SELECT 'normal', greatest(count(*) - count(*) FILTER (is_replay), 0) FROM run",
    "a27_quality_trend": f"""WITH {RUN}, t AS (SELECT strftime(created, '%Y-%m-%d') AS day, floor(count(*) FILTER (status = 'success') * 10000 / count(*) + 0.5) / 100 AS p FROM run WHERE CAST(created AS DATE) >= DATE '{AS_OF_EVENTS}' - 7 GROUP BY 1)
        SELECT day, CAST(floor(p * CAST(0.9 AS DOUBLE) + 10 + 0.5) AS BIGINT) AS score, CASE WHEN p >= 95 THEN 'healthy' ELSE 'warning' END AS objective FROM t""",
    "a28_order_tabs": f"""WITH {ORD}, {LIN}, c AS (SELECT order_id, count(*) AS open FROM lin WHERE flag = 'N' GROUP BY 1)
        SELECT user_id, count(*) FILTER (status = 101) AS unpaid, count(*) FILTER (status = 201) AS unshipped, count(*) FILTER (status = 301) AS unreceived,
        CAST(coalesce(sum(CASE WHEN status IN (401, 402) THEN coalesce(open, 0) END), 0) AS BIGINT) AS uncommented FROM ord LEFT JOIN c ON c.order_id = ord.id WHERE NOT deleted GROUP BY 1""",
    "a29_cart_totals": f"""WITH {LIN} SELECT order_id, CAST(sum(number) AS BIGINT) AS pieces, CAST(sum(number * price) AS DOUBLE) AS amount, CAST(coalesce(sum(number) FILTER (flag = 'N'), 0) AS BIGINT) AS checked_pieces,
        coalesce(CAST(sum(number * price) FILTER (flag = 'N') AS DOUBLE), 0) AS checked_amount FROM lin WHERE NOT deleted GROUP BY 1""",
    "a30_totals": "SELECT 'users' AS name, count(*) AS total FROM customer UNION ALL SELECT 'goods', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem",
    "a31_comment_counts": f"WITH {ANA} SELECT product_id, count(*) AS total, count(*) FILTER (contains(text, 'http')) AS with_picture FROM ana WHERE NOT deleted GROUP BY 1",
    "a32_group_members": f"WITH {RUN}, g AS (SELECT id % 500 AS group_id, count(DISTINCT user_id) + 1 AS members FROM run GROUP BY 1) SELECT *, members >= 19 AS \"full\" FROM g",
    "a33_open_tasks": f"WITH {ORD} SELECT count(*) FILTER (status <> 401) AS open_tasks, count(*) AS all_tasks FROM ord",
    "a34_spec_groups": f"WITH {LIN} SELECT order_id, string_agg(flag, ',' ORDER BY line_no, flag) AS flags FROM lin GROUP BY 1",
    "a35_coupon_caps": f"""WITH {ORD}, r AS (SELECT id % 97 AS coupon_id, count(*) AS received FROM ord GROUP BY 1)
        SELECT p_partkey AS coupon_id, p_partkey % 5 * 60 AS total, coalesce(received, 0) AS received, p_partkey % 5 = 0 OR coalesce(received, 0) < p_partkey % 5 * 60 AS available FROM part LEFT JOIN r ON r.coupon_id = p_partkey""",
    "a36_histogram": f"""WITH {RUN}, v AS (SELECT tool, list_sort(list(duration_ms)) AS v FROM run GROUP BY 1)
        SELECT tool, len(v) AS n, v[1] AS least, v[-1] AS most, v[CAST(round_even((len(v) - 1) * 0.5, 0) AS INTEGER) + 1] AS p50, v[CAST(round_even((len(v) - 1) * 0.95, 0) AS INTEGER) + 1] AS p95 FROM v""",
    "a37_p95_nearest": f"WITH {RUN} SELECT user_id, quantile_disc(duration_ms, 0.95) AS p95 FROM run GROUP BY 1",
    "a38_confusion": """WITH r AS (SELECT quality = 0 AS e, doc_id % 3 = 0 AS p, toxic = 1 AS h FROM labels),
        c AS (SELECT count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (h) AS h, count(*) FILTER (h AND p) AS hp, count(*) AS n FROM r)
        SELECT tp, fp, tn, fn, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
        round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round(hp / h, 6) AS high_recall, round((tp + fp) / n, 6) AS trigger_rate, round(fn / n, 6) AS unsafe_pass_rate FROM c""",
    "a39_macro_f1": f"""WITH {ANA}, p AS (SELECT label AS truth, CASE WHEN id % 4 = 0 THEN 'neutral' WHEN id % 7 = 0 THEN 'mixed' ELSE label END AS said FROM ana WHERE label IS NOT NULL),
        c AS (SELECT truth AS c FROM p UNION SELECT said FROM p), f AS (SELECT c, 2 * count(*) FILTER (truth = c AND said = c) / (count(*) FILTER (truth = c) + count(*) FILTER (said = c)) AS f1 FROM c, p GROUP BY 1)
        SELECT count(*) AS classes, round(avg(f1), 6) AS macro_f1 FROM f""",
    "a43_http_counters": f"WITH {RUN} SELECT count(*) AS requests, count(*) FILTER (status = 'failed') AS errors, CAST(sum(duration_ms) AS BIGINT) AS busy_ms FROM run",
    "a44_agreement": f"""WITH {ANA}, b AS (SELECT label IS NOT DISTINCT FROM (CASE WHEN id % 9 = 0 THEN 'neutral' ELSE label END) AS x, rating = 1 + id % 5 - id % 2 * (id % 3) AS y FROM ana)
        SELECT count(*) AS n, round(avg(CAST(x AS INTEGER)), 6) AS same_label, round(avg(CAST(y AS INTEGER)), 6) AS same_rating, round(avg(CAST(x AND y AS INTEGER)), 6) AS same_all FROM b""",
    "a45_divergence": f"""WITH {ANA}, k AS (SELECT coalesce(label, 'none') AS key, count(*) FILTER (id % 2 = 0) AS a, count(*) FILTER (id % 2 = 1) AS b FROM ana GROUP BY 1),
        p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM k)
        SELECT round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 6) AS divergence, round(max(p), 6) AS dominant_share FROM p""",
    "a46_min_sku_price": f"WITH {LIN} SELECT p_partkey AS goods_id, coalesce(CAST(min(price) AS DOUBLE), 2147483647) AS price FROM part LEFT JOIN lin ON goods_id = p_partkey AND p_partkey % 3 = 0 GROUP BY 1",
}

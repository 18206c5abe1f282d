"""Filter, listing, join, ranking and state queries with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import predicates as P
from ledgerlark.operators import commerce as C
from ledgerlark.operators import listing as L
from ledgerlark.plans.views import ANA, LIN, ORD, RUN, analyses, lines, orders, runs
from ledgerlark.session import table


def _goods(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").alias("size"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"), (F.col("p_partkey") % 17 == 0).alias("deleted"),
    )


GOODS = """goods AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS category, p_size AS size, CAST(p_retailprice AS DECIMAL(12,2)) AS price, p_partkey % 17 = 0 AS deleted FROM part)"""


def _users(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))


USERS = "users AS (SELECT c_custkey AS user_id, c_name AS user_name, c_mktsegment AS segment, c_nationkey AS nation FROM customer)"


def _chunks(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.upper(F.left("source", F.lit(1))), F.substring("source", 2, 9), F.lit(" ")).alias("tenant_id"), (F.col("doc_id") % 7 != 0).alias("active"),
        (F.col("doc_id") % 17 == 0).alias("deleted"), F.when(F.col("doc_id") % 5 == 0, "public").otherwise("private").alias("access_scope"),
    )


def _coupons(s, d):  # noqa: ANN001, ANN202
    o = orders(s, d)
    scope = F.when(F.col("id") % 3 == 2, F.array(F.col("id") % 20, (F.col("id") + 7) % 20)).otherwise(F.array(F.lit(0).cast("bigint")))
    return o.select(
        F.col("id").alias("coupon_id"), "user_id", (F.col("id") % 50 + 5).alias("discount"), (F.col("id") % 5 * 20000).cast("decimal(12,2)").alias("least"), F.when(F.col("id") % 3 == 2, 2).otherwise(0).alias("kind"),
        scope.alias("scope"), F.date_sub(F.to_date("created"), 30).alias("starts"), F.date_add(F.to_date("created"), 30).alias("ends"),
    )


def _carts(s, d):  # noqa: ANN001, ANN202
    own = orders(s, d).select(F.col("id").alias("order_id"), "user_id", F.to_date("created").alias("day"))
    return lines(s, d).where("line_no = 1").join(own, "order_id").select("user_id", (F.col("goods_id") % 20).alias("goods_id"), F.lit(None).cast("bigint").alias("category"), (F.col("price") * F.col("number")).alias("amount"), "day")


COUPONS = f"""{ORD}, {LIN}, coupon AS (SELECT id AS coupon_id, user_id, id % 50 + 5 AS discount, CAST(id % 5 * 20000 AS DECIMAL(12,2)) AS least, id % 3 = 2 AS scoped, [id % 20, (id + 7) % 20] AS scope,
    CAST(created AS DATE) - 30 AS starts, CAST(created AS DATE) + 30 AS ends FROM ord),
    cart AS (SELECT user_id, goods_id % 20 AS goods_id, price * number AS amount, CAST(created AS DATE) AS day FROM lin JOIN ord ON ord.id = order_id WHERE line_no = 1),
    valid AS (SELECT c.user_id, coupon_id, discount, sum(amount) AS amount FROM coupon c JOIN cart k ON k.user_id = c.user_id AND day BETWEEN starts AND ends AND (NOT scoped OR list_contains(scope, k.goods_id))
        GROUP BY c.user_id, coupon_id, discount, least HAVING sum(amount) >= least)"""


def _coupon_list(s, d):  # noqa: ANN001, ANN202
    return C.eligible_coupons(_coupons(s, d), _carts(s, d)).select("user_id", "coupon_id", "discount", F.col("amount").cast("double").alias("amount"))


def _pairs(s, d):  # noqa: ANN001, ANN202
    return runs(s, d).where("is_replay").select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))


_FINDING_KEYS = ["order_id", "goods_id", "supplier_id", "flag", "state"]


def _exceptions(s, d):  # noqa: ANN001, ANN202
    return lines(s, d).where("order_id % 5 = 0").select(*_FINDING_KEYS)


def _exception_rows(s, d):  # noqa: ANN001, ANN202
    """Exceptions with dates: some are orphans, doubled, expired, too long without a reason, or of an unknown severity."""
    x = lines(s, d).where("order_id % 5 = 0 and line_no <= 2").select((F.col("order_id") * 10 + F.col("line_no")).alias("eid"), F.when(F.col("order_id") % 35 == 0, -F.col("order_id")).otherwise(F.col("order_id")).alias("order_id"), F.col("line_no"), F.col("flag"), F.col("shipped"))
    return x.select("eid", "order_id", F.when(F.col("order_id") % 15 == 0, 1).otherwise(F.col("line_no")).alias("line_no"), F.when(F.col("flag") == "R", "bogus").otherwise("HIGH").alias("severity"), F.to_date("shipped").alias("starts"), F.expr("date_add(to_date(shipped), cast(line_no * 60 as int))").alias("ends"), F.when(F.col("order_id") % 2 == 0, "known").alias("reason"))


def exception_errors(s, d):  # noqa: ANN001, ANN202
    """Every exception with its error codes: unknown severity, a window of over 90 days without a reason, expired, a
    key seen before, and a key without a finding."""
    x = _exception_rows(s, d)
    again = F.row_number().over(Window.partitionBy("order_id", "line_no").orderBy("eid", "starts", "severity")) > 1
    there = lines(s, d).select("order_id", "line_no", F.lit(True).alias("_found")).distinct()
    x = x.withColumn("_again", again).join(there, ["order_id", "line_no"], "left")
    codes = F.array_compact(F.array(
        F.when(~F.lower("severity").isin("high", "low"), "bad_severity"), F.when((F.datediff("ends", "starts") > 90) & F.col("reason").isNull(), "too_long"),
        F.when(F.col("ends") < F.lit("1996-01-01").cast("date"), "expired"), F.when(F.col("_again"), "duplicate"), F.when(F.col("_found").isNull(), "orphan"),
    ))
    return x.select("eid", F.array_join(codes, ",").alias("errors"))


LEGAL = [(101, "pay", 201), (101, "cancel", 102), (201, "ship", 301), (301, "confirm", 401), (402, "refund", 203)]

QUERIES = {
    "f10_filtered_list": lambda s, d: L.list_entity(_goods(s, d), P.criteria([P.given(("brand", "like", "Brand#1%"), ("size", ">=", None), ("name", "like", "  "))]), ["id", "name", "brand"], sort="id", order="desc", page=2, limit=20),
    "f01_typed_criteria": lambda s, d: _goods(s, d).where(P.criteria([[("size", "between", (5, 15)), ("brand", "<>", "Brand#11")], [("size", "in", [30, 40]), ("category", "is not null")], [("size", "not between", (1, 48)), ("name", "not like", "%e%")], []])).select("id", "size"),
    "f07_column_compare": lambda s, d: orders(s, d).agg(*(F.count(F.when(P.criterion("status", op, F.col("user_id")), 1)).alias(name) for name, op in (("equal", "="), ("other", "<>"), ("less", "<"), ("at_most", "<="), ("more", ">"), ("at_least", ">=")))),
    "f11_keyword_or": lambda s, d: P.active(_goods(s, d)).where(P.criteria([[("name", "like", "%blue%"), ("size", ">", 10)], [("category", "like", "%blue%"), ("size", ">", 10)]]) | P.criterion("brand", "=", "BRAND#12", fold=True)).select("id", "name"),
    "f12_any_contains": lambda s, d: _goods(s, d).where(P.any_contains(["name", "brand", "category"], "1")).select("id"),
    "f13_range_bounds": lambda s, d: orders(s, d).agg(
        F.count(F.when(F.col("day").between("1995-01-01", "1995-03-31"), 1)).alias("inclusive"), F.count(F.when((F.col("day") >= "1995-01-01") & (F.col("day") < "1995-03-31"), 1)).alias("exclusive")
    ),
    "f16_distinct": lambda s, d: _goods(s, d).select("brand", "category").distinct(),
    "f17_count": lambda s, d: P.active(orders(s, d)).where(P.criterion("status", "in", [401, 402])).agg(F.count("*").alias("n")),
    "f18_select_one": lambda s, d: P.active(orders(s, d)).where("user_id % 7 = 3").orderBy("id").limit(1).select("id", "user_id"),
    "f19_exists": lambda s, d: _users(s, d).join(orders(s, d).where("status = 401"), "user_id", "left_semi").select("user_id"),
    "f20_optimistic_update": lambda s, d: orders(s, d).select("id", F.when((F.col("status") == 101) & (F.col("id") % 3 == 0), 102).otherwise(F.col("status")).alias("status")).groupBy("status").agg(F.count("*").alias("n")),
    "f21_logical_delete": lambda s, d: P.active(P.mark_deleted(orders(s, d), F.col("status") == 402)).agg(F.count("*").alias("n")),
    "f22_acl": lambda s, d: _chunks(s, d).where(P.visible(" SRC3")).select("id"),
    "f24_split_guard": lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "holdout").otherwise("mystery").alias("split")).where(~F.col("split").isin("train", "validation")).groupBy("split").agg(F.count("*").alias("violations")),
    "f25_field_allow_list": lambda s, d: runs(s, d).select(*[c for c in runs(s, d).columns if c in {"id", "status", "duration_ms", "trace_id"}]),
    "f26_status_tab": lambda s, d: orders(s, d).where(P.status_tab(4)).groupBy("status").agg(F.count("*").alias("n")).unionByName(orders(s, d).where(P.status_tab(0)).agg(F.lit(0).alias("status"), F.count("*").alias("n"))),
    "f27_permissions": lambda s, d: runs(s, d).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("permissions"), F.max(F.col("tool") == "purchase").alias("may_buy")),
    "f28_prefix_map": lambda s, d: _users(s, d).where(F.col("user_name").like("Customer#00000000_%")).select(F.col("user_name").alias("key"), "segment"),
    "f29_read_toggle": lambda s, d: orders(s, d).agg(F.count(F.when(F.nullif(F.col("status"), F.lit(101)).isNull(), 1)).alias("unread"), F.count(F.nullif(F.col("status"), F.lit(101))).alias("read")),
    "l02_page": lambda s, d: L.page_of(orders(s, d), "amount", "desc", page=10_000_000, limit=7).select("id", F.col("amount").cast("double").alias("amount")),
    "l03_page_past_end": lambda s, d: L.page_of(orders(s, d), "id", page=10_000_000, limit=7, reasonable=False).select("id"),
    "l04_topk": lambda s, d: L.first_k(orders(s, d), 20, F.desc("amount"), F.asc("id")).select("id", F.col("amount").cast("double").alias("amount")),
    "l05_fifo": lambda s, d: orders(s, d).where("status = 101").orderBy("created", "id").limit(20).select("id"),
    "l07_union_topk": lambda s, d: L.union_first_k(runs(s, d).where("status = 'failed'").select("id", "created", F.lit("run").alias("kind")), runs(s, d).where("is_replay").select("id", "created", F.lit("replay").alias("kind")), 10, F.desc("created"), F.desc("id"), F.asc("kind")),
    "u02_set_operations": lambda s, d: lines(s, d).groupBy("order_id").agg(F.collect_set("flag").alias("a"), F.collect_set("state").alias("b")).select("order_id", F.size(F.array_intersect("a", F.array(F.lit("N"), F.lit("R")))).alias("both"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("only")),
    "j01_order_page": lambda s, d: C.order_ids(orders(s, d), _users(s, d), lines(s, d), F.col("segment") == "BUILDING"),
    "j02_order_detail": lambda s, d: C.order_details(C.order_ids(orders(s, d), _users(s, d), lines(s, d), F.col("segment") == "BUILDING"), orders(s, d), _users(s, d), lines(s, d)).select("id", "user_name", F.explode("goods").alias("g")).select("id", "user_name", "g.line_no", "g.goods_id", "g.number"),
    "j04_case_build": lambda s, d: analyses(s, d).where("label = 'negative' and not deleted").join(runs(s, d).groupBy((F.col("id") % 1000).alias("id")).agg(F.max("tool").alias("feedback")), "id", "left").select("id", F.concat(F.lit("Risk case #"), F.col("id").cast("string")).alias("title"), F.concat_ws(",", F.lit("negative"), F.col("feedback"), F.col("lang")).alias("tags")),
    "j05_pending_anti": lambda s, d: C.pending(orders(s, d).select("id", "created"), table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), "id", 15, F.desc("created"), F.desc("id")).select("id"),
    "j06_unreceived_anti": lambda s, d: _goods(s, d).join(lines(s, d).where("number > 40").select(F.col("goods_id").alias("id")), "id", "left_anti").select("id"),
    "j07_semi_categories": lambda s, d: _goods(s, d).select("category").distinct().join(_goods(s, d).where("name like '%a%' and size = 7").select("category"), "category", "left_semi"),
    "j08_lookup_default": lambda s, d: C.lookup(runs(s, d).where("tool = 'view'").select("id", (F.col("user_id") * 100).alias("user_id")), _users(s, d).select("user_id", "user_name"), "user_id", {"user_name": ""}).select("id", "user_name"),
    "j09_lookup_inner": lambda s, d: runs(s, d).where("tool = 'click'").select("id", (F.col("user_id") * 15).alias("goods_id")).join(_goods(s, d).select(F.col("id").alias("goods_id"), "price"), "goods_id").select("id", (F.col("price") - 5).cast("double").alias("deal")),
    "j11_polymorphic": lambda s, d: C.polymorphic(runs(s, d).select("id", (F.col("id") % 2).cast("int").alias("type"), (F.col("user_id") % 60).alias("value_id")), _goods(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))),
    "j12_valid_cart": lambda s, d: lines(s, d).join(_goods(s, d).where("not deleted and size < 25").select(F.col("id").alias("goods_id")), "goods_id", "left_semi").groupBy("order_id").agg(F.count("*").alias("valid")),
    "j13_tree": lambda s, d: C.tree(table(s, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("up")), table(s, d, "customer").select(F.col("c_nationkey").alias("up"))),
    "j14_first_child": lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("first_child")),
    "j15_latest_per_key": lambda s, d: C.latest_per_key(runs(s, d).select("user_id", "id", "tool", "status"), "user_id", "id"),
    "j16_coupon_eligible": _coupon_list,
    "w05_best_coupon": lambda s, d: C.best_coupon(C.eligible_coupons(_coupons(s, d), _carts(s, d))),
    "j20_run_compare": lambda s, d: C.compare_runs(runs(s, d), _pairs(s, d), ["tool", "status"], "duration_ms"),
    "j21_unregistered": lambda s, d: C.unregistered(runs(s, d), runs(s, d).where("tool in ('view', 'click')").select("tool").distinct(), "tool"),
    "j22_split_overlap": lambda s, d: C.overlap(table(s, d, "documents").withColumn("split", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))), "split", F.lower(F.trim("text"))),
    "w02_latest_analysis": lambda s, d: C.latest_per_key(analyses(s, d).where("not deleted").select("product_id", "id", "rating"), "product_id", "id"),
    "w03_first_per_key": lambda s, d: C.first_per_key(runs(s, d).select(F.nullif(F.col("user_id") % 40, F.lit(0)).alias("k"), "tool", "id"), ["k", "tool"], "id"),
    "w04_topn_per_group": lambda s, d: C.top_per_group(_goods(s, d).select("category", "id", "price"), "category", 4, F.desc("price"), F.asc("id")).select("category", "id", "rank"),
    "w06_minmax": lambda s, d: C.min_max(runs(s, d).select("id", "user_id", F.col("duration_ms").cast("double").alias("score")), "user_id", "score").select("id", F.round("scaled", 6).alias("scaled")),
    "w08_step_gaps": lambda s, d: runs(s, d).selectExpr("id", "user_id", "timestampdiff(MILLISECOND, lag(created) over (partition by user_id order by created, id), created) as gap_ms"),
    "w09_rolling_failures": lambda s, d: C.rolling_failures(runs(s, d), "user_id").select("id", "failures", "open"),
    "c41_pricing": lambda s, d: C.price_orders(lines(s, d), orders(s, d).where("id % 4 = 0").select(F.col("id").alias("order_id"), (F.col("id") % 500 * 100).cast("decimal(12,2)").alias("discount"))),
    "c32_validity": lambda s, d: _coupons(s, d).select("coupon_id", F.expr("case when coupon_id % 2 = 0 then date'1997-06-01' between starts and ends else date'1997-06-01' <= date_add(starts, cast(coupon_id % 400 as int)) end").alias("valid")),
    "m05_order_moves": lambda s, d: C.transitions(orders(s, d), orders(s, d).where("id % 3 > 0").select("id", F.when(F.col("id") % 3 == 1, "pay").otherwise("refund").alias("action")), LEGAL).select("id", "new_status", "refused"),
    "m05_stock": lambda s, d: C.apply_stock(_goods(s, d).select(F.col("id").alias("goods_id"), (F.col("size") * 20).cast("bigint").alias("number")), lines(s, d).select("goods_id", F.when(F.col("flag") == "R", F.col("number")).otherwise(-F.col("number")).alias("delta"))),
    "m07_auto_confirm": lambda s, d: C.expired(orders(s, d), "1999-01-01", 365, 101).agg(F.count("*").alias("n"), F.max("day").alias("latest")),
    "t04_unpaid_timeout": lambda s, d: orders(s, d).where((F.col("status") == 101) & (F.col("created") + F.expr("interval 30 minutes") <= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))).agg(F.count("*").alias("cancelled")),
    "s12_insert_ignore": lambda s, d: C.insert_ignore(orders(s, d).where("id % 2 = 0").select("user_id", "status"), orders(s, d).where("id % 2 = 1").select(F.nullif("user_id", F.lit(7)).alias("user_id"), "status", "id"), ["user_id", "status"], "id"),
    "s13_upsert": lambda s, d: C.upsert(_goods(s, d).where("id % 3 > 0").select("id", "name", "size"), _goods(s, d).where("id % 2 = 0").select("id", F.upper("name").alias("name"), (F.col("size") + 1).alias("size")), "id", ["size"]),
    "s15_delete_by_subquery": lambda s, d: lines(s, d).join(orders(s, d).where("priority like '1-%'").select(F.col("id").alias("order_id")), "order_id", "left_anti").agg(F.count("*").alias("n"), F.sum("number").alias("pieces")),
    "s16_backfill": lambda s, d: _users(s, d).select("user_id", F.when(F.col("segment").like("B%"), "trade").otherwise(F.lower("segment")).alias("kind"), F.expr("try_cast(replace(user_name, 'Customer#', '') as bigint)").alias("number")),
    "s10_manifest": lambda s, d: table(s, d, "documents").agg(F.countDistinct("source").alias("tenants"), F.count("*").alias("chunks"), F.sum(F.size(F.split(F.trim("text"), " "))).alias("pieces")),
    "g02_excepted_split": lambda s, d: lines(s, d).select(*_FINDING_KEYS).join(_exceptions(s, d).distinct(), _FINDING_KEYS, "left_anti").groupBy("flag").agg(F.count("*").alias("open")),
    "g03_exception_validation": exception_errors,
    "g04_severity_matrix": lambda s, d: C.severity_matrix(lines(s, d), _exceptions(s, d), _FINDING_KEYS, "flag"),
    "g05_report_metadata": lambda s, d: runs(s, d).groupBy("tool").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("created", "yyyy-MM-dd"))), ",").alias("days")),
    "g06_inventory": lambda s, d: C.latest_per_key(lines(s, d).select("goods_id", "order_id", "line_no", "state", (F.col("order_id") * 10 + F.col("line_no")).alias("seq")), "goods_id", "seq").select("goods_id", "order_id", F.when(F.col("state") == "O", "open").when(F.col("line_no") > 3, "late").otherwise("closed").alias("class")),
}

ORACLE_SQL = {
    "f10_filtered_list": f"WITH {GOODS} SELECT id, name, brand FROM goods WHERE NOT deleted AND brand LIKE 'Brand#1%' ORDER BY id DESC LIMIT 20 OFFSET 20",
    "f01_typed_criteria": f"WITH {GOODS} SELECT id, size FROM goods WHERE (size BETWEEN 5 AND 15 AND brand <> 'Brand#11') OR (size IN (30, 40) AND category IS NOT NULL) OR (size NOT BETWEEN 1 AND 48 AND name NOT LIKE '%e%')",
    "f07_column_compare": f"WITH {ORD} SELECT count(*) FILTER (status = user_id) AS equal, count(*) FILTER (status <> user_id) AS other, count(*) FILTER (status < user_id) AS less, count(*) FILTER (status <= user_id) AS at_most, count(*) FILTER (status > user_id) AS more, count(*) FILTER (status >= user_id) AS at_least FROM ord",
    "f11_keyword_or": f"WITH {GOODS} SELECT id, name FROM goods WHERE NOT deleted AND ((size > 10 AND (name LIKE '%blue%' OR category LIKE '%blue%')) OR lower(brand) = 'brand#12')",
    "f12_any_contains": f"WITH {GOODS} SELECT id FROM goods WHERE contains(name, '1') OR contains(brand, '1') OR contains(category, '1')",
    "f13_range_bounds": f"WITH {ORD} SELECT count(*) FILTER (day BETWEEN '1995-01-01' AND '1995-03-31') AS inclusive, count(*) FILTER (day >= '1995-01-01' AND day < '1995-03-31') AS exclusive FROM ord",
    "f16_distinct": f"WITH {GOODS} SELECT DISTINCT brand, category FROM goods",
    "f17_count": f"WITH {ORD} SELECT count(*) AS n FROM ord WHERE NOT deleted AND status IN (401, 402)",
    "f18_select_one": f"WITH {ORD} SELECT id, user_id FROM ord WHERE NOT deleted AND user_id % 7 = 3 ORDER BY id LIMIT 1",
    "f19_exists": f"WITH {ORD}, {USERS} SELECT user_id FROM users u WHERE EXISTS (SELECT 1 FROM ord WHERE status = 401 AND ord.user_id = u.user_id)",
    "f20_optimistic_update": f"WITH {ORD} SELECT CASE WHEN status = 101 AND id % 3 = 0 THEN 102 ELSE status END AS status, count(*) AS n FROM ord GROUP BY 1",
    "f21_logical_delete": f"WITH {ORD} SELECT count(*) AS n FROM ord WHERE NOT deleted AND status <> 402",
    "f22_acl": "SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 17 <> 0 AND (doc_id % 5 = 0 OR source = 'src3')",
    "f24_split_guard": "SELECT CASE WHEN doc_id % 10 = 8 THEN 'holdout' ELSE 'mystery' END AS split, count(*) AS violations FROM documents WHERE doc_id % 10 >= 8 GROUP BY 1",
    "f25_field_allow_list": f"WITH {RUN} SELECT id, status, duration_ms FROM run",
    "f26_status_tab": f"WITH {ORD} SELECT status, count(*) AS n FROM ord WHERE status IN (401, 402) GROUP BY 1 UNION ALL SELECT 0, count(*) FROM ord",
    "f27_permissions": f"WITH {RUN} SELECT user_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS permissions, bool_or(tool = 'purchase') AS may_buy FROM run GROUP BY 1",
    "f28_prefix_map": f"WITH {USERS} SELECT user_name AS key, segment FROM users WHERE user_name LIKE 'Customer#00000000_%'",
    "f29_read_toggle": f"WITH {ORD} SELECT count(*) FILTER (status = 101) AS unread, count(*) FILTER (status <> 101) AS read FROM ord",
    "l02_page": f"WITH {ORD} SELECT id, CAST(amount AS DOUBLE) AS amount FROM ord ORDER BY amount DESC NULLS LAST, id LIMIT 7 OFFSET (SELECT (count(*) - 1) // 7 * 7 FROM ord)",
    "l03_page_past_end": f"WITH {ORD} SELECT id FROM ord WHERE false",
    "l04_topk": f"WITH {ORD} SELECT id, CAST(amount AS DOUBLE) AS amount FROM ord ORDER BY ord.amount DESC, id LIMIT 20",
    "l05_fifo": f"WITH {ORD} SELECT id FROM ord WHERE status = 101 ORDER BY created, id LIMIT 20",
    "l07_union_topk": f"WITH {RUN} SELECT * FROM (SELECT id, created, 'run' AS kind FROM run WHERE status = 'failed' UNION ALL SELECT id, created, 'replay' FROM run WHERE is_replay) ORDER BY created DESC, id DESC, kind LIMIT 10",
    "u02_set_operations": f"""WITH {LIN}, g AS (SELECT order_id, list_distinct(list(flag)) AS a, list_distinct(list(state)) AS b FROM lin GROUP BY 1)
        SELECT order_id, CAST(len(list_intersect(a, ['N', 'R'])) AS INTEGER) AS both, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS either, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INTEGER) AS "only" FROM g""",
    "j01_order_page": f"WITH {ORD}, {LIN}, {USERS} SELECT DISTINCT ord.id FROM ord LEFT JOIN users USING (user_id) LEFT JOIN lin ON order_id = ord.id WHERE NOT lin.deleted AND segment = 'BUILDING'",
    "j02_order_detail": f"WITH {ORD}, {LIN}, {USERS} SELECT ord.id, user_name, line_no, goods_id, number FROM ord LEFT JOIN users USING (user_id) JOIN lin ON order_id = ord.id WHERE NOT lin.deleted AND segment = 'BUILDING'",
    "j04_case_build": f"""WITH {ANA}, {RUN}, f AS (SELECT id % 1000 AS id, max(tool) AS feedback FROM run GROUP BY 1)
        SELECT ana.id, 'Risk case #' || ana.id AS title, concat_ws(',', 'negative', feedback, lang) AS tags FROM ana LEFT JOIN f ON f.id = ana.id WHERE label = 'negative' AND NOT deleted""",
    "j05_pending_anti": f"""WITH {ORD}, t AS (SELECT id, created FROM ord ORDER BY created DESC, id DESC LIMIT 75)
        SELECT id FROM t WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY created DESC, id DESC LIMIT 15""",
    "j06_unreceived_anti": f"WITH {GOODS}, {LIN} SELECT id FROM goods WHERE id NOT IN (SELECT goods_id FROM lin WHERE number > 40)",
    "j07_semi_categories": f"WITH {GOODS} SELECT DISTINCT category FROM goods WHERE category IN (SELECT category FROM goods WHERE name LIKE '%a%' AND size = 7)",
    "j08_lookup_default": f"WITH {RUN}, {USERS} SELECT run.id, coalesce(user_name, '') AS user_name FROM run LEFT JOIN users ON users.user_id = run.user_id * 100 WHERE tool = 'view'",
    "j09_lookup_inner": f"WITH {RUN}, {GOODS} SELECT run.id, CAST(price - 5 AS DOUBLE) AS deal FROM run JOIN goods ON goods.id = user_id * 15 WHERE tool = 'click'",
    "j11_polymorphic": f"""WITH {RUN}, {GOODS}, r AS (SELECT id, CAST(id % 2 AS INTEGER) AS type, user_id % 60 AS value_id FROM run)
        SELECT r.id, type, value_id, CASE WHEN type = 0 THEN goods.name ELSE s_name END AS name FROM r LEFT JOIN goods ON goods.id = value_id LEFT JOIN supplier ON s_suppkey = value_id""",
    "j12_valid_cart": f"WITH {LIN}, {GOODS} SELECT order_id, count(*) AS valid FROM lin JOIN goods ON goods.id = goods_id WHERE NOT goods.deleted AND size < 25 GROUP BY 1",
    "j13_tree": "SELECT r_name AS level1, n_name AS level2, count(c_custkey) AS leaves FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "j14_first_child": "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS first_child FROM nation GROUP BY 1",
    "j15_latest_per_key": f"WITH {RUN} SELECT user_id, id, tool, status FROM run QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) = 1",
    "j16_coupon_eligible": f"WITH {COUPONS} SELECT user_id, coupon_id, discount, CAST(amount AS DOUBLE) AS amount FROM valid",
    "w05_best_coupon": f"WITH {COUPONS} SELECT user_id, coupon_id, discount FROM valid QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY discount DESC, coupon_id) = 1",
    "j20_run_compare": f"""WITH {RUN} SELECT l.id AS left_id, r.id AS right_id, l.tool IS DISTINCT FROM r.tool AS tool_changed, l.status IS DISTINCT FROM r.status AS status_changed, CAST(r.duration_ms - l.duration_ms AS DOUBLE) AS score_change
        FROM run l JOIN run r ON r.id = l.id + 1 WHERE l.is_replay""",
    "j21_unregistered": f"WITH {RUN} SELECT tool, count(*) AS total FROM run WHERE tool NOT IN ('view', 'click') GROUP BY 1",
    "j22_split_overlap": """WITH k AS (SELECT DISTINCT 's' || doc_id % 3 AS s, lower(trim(text, ' ')) AS k FROM documents)
        SELECT x.s AS a, y.s AS b, count(*) AS shared FROM k x JOIN k y ON x.k = y.k AND x.s < y.s GROUP BY 1, 2""",
    "w02_latest_analysis": f"WITH {ANA} SELECT product_id, id, rating FROM ana WHERE NOT deleted QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY id DESC) = 1",
    "w03_first_per_key": f"""WITH {RUN}, r AS (SELECT nullif(user_id % 40, 0) AS k, tool, id FROM run)
        SELECT k, tool, id FROM r WHERE k IS NULL UNION ALL SELECT k, tool, min(id) FROM r WHERE k IS NOT NULL GROUP BY 1, 2""",
    "w04_topn_per_group": f"WITH {GOODS} SELECT category, id, CAST(row_number() OVER (PARTITION BY category ORDER BY price DESC, id) AS INTEGER) AS rank FROM goods QUALIFY rank <= 4",
    "w06_minmax": f"""WITH {RUN}, s AS (SELECT id, CAST(duration_ms AS DOUBLE) AS x, min(CAST(duration_ms AS DOUBLE)) OVER (PARTITION BY user_id) AS lo, max(CAST(duration_ms AS DOUBLE)) OVER (PARTITION BY user_id) AS hi FROM run)
        SELECT id, round(CASE WHEN hi <= lo THEN CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END ELSE (x - lo) / (hi - lo) END, 6) AS scaled FROM s""",
    "w08_step_gaps": f"WITH {RUN} SELECT id, user_id, CAST(floor((epoch_us(created) - epoch_us(lag(created) OVER (PARTITION BY user_id ORDER BY created, id))) / 1000) AS BIGINT) AS gap_ms FROM run",
    "w09_rolling_failures": f"""WITH {RUN} SELECT id, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failures, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER w >= 3 AS open FROM run
        WINDOW w AS (PARTITION BY user_id ORDER BY created, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "c41_pricing": f"""WITH {ORD}, {LIN}, g AS (SELECT order_id, sum(price * number) AS goods FROM lin GROUP BY 1), x AS (SELECT order_id, goods, CASE WHEN goods < 88 THEN 8.00 ELSE 0.00 END AS freight, CASE WHEN order_id % 4 = 0 AND ord.id IS NOT NULL THEN CAST(order_id % 500 * 100 AS DECIMAL(12,2)) ELSE 0 END AS discount FROM g LEFT JOIN ord ON ord.id = order_id)
        SELECT order_id, CAST(goods AS DOUBLE) AS goods, CAST(freight AS DOUBLE) AS freight, CAST(discount AS DOUBLE) AS discount, CAST(greatest(0, goods + freight - discount) AS DOUBLE) AS paid FROM x""",
    "c32_validity": f"WITH {COUPONS} SELECT coupon_id, CASE WHEN coupon_id % 2 = 0 THEN DATE '1997-06-01' BETWEEN starts AND ends ELSE DATE '1997-06-01' <= starts + CAST(coupon_id % 400 AS INTEGER) END AS valid FROM coupon",
    "m05_order_moves": f"""WITH {ORD}, m AS (SELECT id, status, CASE id % 3 WHEN 1 THEN 'pay' WHEN 2 THEN 'refund' END AS action FROM ord)
        SELECT id, CASE WHEN status = 101 AND action = 'pay' THEN 201 WHEN status = 402 AND action = 'refund' THEN 203 ELSE status END AS new_status,
        action IS NOT NULL AND NOT coalesce((status = 101 AND action = 'pay') OR (status = 402 AND action = 'refund'), false) AS refused FROM m""",
    "m05_stock": f"""WITH {GOODS}, {LIN}, c AS (SELECT goods_id, CAST(sum(CASE WHEN flag = 'R' THEN number ELSE -number END) AS BIGINT) AS delta FROM lin GROUP BY 1)
        SELECT id AS goods_id, CAST(CASE WHEN size * 20 + coalesce(delta, 0) >= 0 THEN size * 20 + coalesce(delta, 0) ELSE size * 20 END AS BIGINT) AS number, size * 20 + coalesce(delta, 0) >= 0 AS applied FROM goods LEFT JOIN c ON c.goods_id = id""",
    "m07_auto_confirm": f"WITH {ORD} SELECT count(*) AS n, max(day) AS latest FROM ord WHERE status = 101 AND CAST(created AS DATE) <= DATE '1999-01-01' - 365",
    "t04_unpaid_timeout": f"WITH {ORD} SELECT count(*) AS cancelled FROM ord WHERE status = 101 AND created + INTERVAL 30 MINUTE <= TIMESTAMP '2000-01-01'",
    "s12_insert_ignore": f"""WITH {ORD}, b AS (SELECT nullif(user_id, 7) AS user_id, status, id FROM ord WHERE id % 2 = 1), f AS (SELECT * FROM b WHERE user_id IS NULL UNION ALL SELECT user_id, status, min(id) FROM b WHERE user_id IS NOT NULL GROUP BY 1, 2)
        SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM ord WHERE ord.id % 2 = 0 AND ord.user_id = f.user_id AND ord.status = f.status)""",
    "s13_upsert": f"""WITH {GOODS}, t AS (SELECT id, name, size FROM goods WHERE id % 3 > 0), b AS (SELECT id, upper(name) AS name, size + 1 AS size FROM goods WHERE id % 2 = 0)
        SELECT coalesce(t.id, b.id) AS id, CASE WHEN t.id IS NULL THEN b.name ELSE t.name END AS name, CASE WHEN b.id IS NULL THEN t.size ELSE b.size END AS size FROM t FULL JOIN b ON t.id = b.id""",
    "s15_delete_by_subquery": f"WITH {ORD}, {LIN} SELECT count(*) AS n, CAST(sum(number) AS BIGINT) AS pieces FROM lin WHERE order_id NOT IN (SELECT id FROM ord WHERE priority LIKE '1-%')",
    "s16_backfill": f"WITH {USERS} SELECT user_id, CASE WHEN segment LIKE 'B%' THEN 'trade' ELSE lower(segment) END AS kind, TRY_CAST(replace(user_name, 'Customer#', '') AS BIGINT) AS number FROM users",
    "s10_manifest": "SELECT count(DISTINCT source) AS tenants, count(*) AS chunks, CAST(sum(len(string_split(trim(text, ' '), ' '))) AS BIGINT) AS pieces FROM documents",
    "g02_excepted_split": f"WITH {LIN}, e AS (SELECT order_id, goods_id, supplier_id, flag, state FROM lin WHERE order_id % 5 = 0) SELECT flag, count(*) AS open FROM lin ANTI JOIN e USING (order_id, goods_id, supplier_id, flag, state) GROUP BY 1",
    "g03_exception_validation": f"""WITH {LIN}, x AS (SELECT order_id * 10 + line_no AS eid, CASE WHEN order_id % 35 = 0 THEN -order_id ELSE order_id END AS order_id, line_no AS l, flag, shipped FROM lin WHERE order_id % 5 = 0 AND line_no <= 2),
        y AS (SELECT eid, order_id, CASE WHEN order_id % 15 = 0 THEN 1 ELSE l END AS line_no, CASE WHEN flag = 'R' THEN 'bogus' ELSE 'HIGH' END AS severity, l * 60 AS days, CAST(shipped AS DATE) + l * 60 AS ends, CASE WHEN order_id % 2 = 0 THEN 'known' END AS reason FROM x),
        z AS (SELECT y.*, row_number() OVER (PARTITION BY order_id, line_no ORDER BY eid, ends, severity) > 1 AS again, EXISTS (SELECT 1 FROM lin WHERE lin.order_id = y.order_id AND lin.line_no = y.line_no) AS found FROM y)
        SELECT eid, concat_ws(',', CASE WHEN lower(severity) NOT IN ('high', 'low') THEN 'bad_severity' END, CASE WHEN days > 90 AND reason IS NULL THEN 'too_long' END, CASE WHEN ends < DATE '1996-01-01' THEN 'expired' END,
        CASE WHEN again THEN 'duplicate' END, CASE WHEN NOT found THEN 'orphan' END) AS errors FROM z""",
    "g04_severity_matrix": f"""WITH {LIN}, e AS (SELECT DISTINCT order_id, goods_id, supplier_id, flag, state, true AS known FROM lin WHERE order_id % 5 = 0)
        SELECT flag, count(*) FILTER (known) AS excepted, count(*) FILTER (known IS NULL) AS open FROM lin LEFT JOIN e USING (order_id, goods_id, supplier_id, flag, state) GROUP BY 1""",
    "g05_report_metadata": f"WITH {RUN} SELECT tool, string_agg(DISTINCT strftime(created, '%Y-%m-%d'), ',' ORDER BY strftime(created, '%Y-%m-%d')) AS days FROM run GROUP BY 1",
    "g06_inventory": f"""WITH {LIN} SELECT goods_id, order_id, CASE WHEN state = 'O' THEN 'open' WHEN line_no > 3 THEN 'late' ELSE 'closed' END AS class FROM lin QUALIFY row_number() OVER (PARTITION BY goods_id ORDER BY order_id * 10 + line_no DESC) = 1""",
}

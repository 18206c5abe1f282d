"""Reporting aggregates over orders, lines, runs and analyses. Each is one pass over its input: the figures that a
dashboard shows side by side are conditional aggregates of a single scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import count_if, percent, rate, safe_div, whole_mean


def daily_users(users: DataFrame) -> DataFrame:
    """Per day: distinct new users."""
    return users.groupBy("day").agg(F.countDistinct("id").alias("users"))


def daily_orders(orders: DataFrame) -> DataFrame:
    """Per day: finished orders, distinct customers, amount, and amount per customer (cents, half up)."""
    done = orders.where(F.col("status").isin(401, 402)).groupBy("day")
    summed = done.agg(F.count("*").alias("orders"), F.countDistinct("user_id").alias("customers"), F.sum("amount").alias("sum"))
    cents = (F.col("sum") * 100).cast("bigint")
    each = F.floor((2 * cents + F.col("customers")) / (2 * F.col("customers"))) / 100
    return summed.select("day", "orders", "customers", F.col("sum").cast("double").alias("amount"), each.alias("amount_per_customer"))


def daily_goods(lines: DataFrame) -> DataFrame:
    """Per day shipped: distinct orders, pieces, and amount of price times pieces."""
    return lines.groupBy(F.date_format("shipped", "yyyy-MM-dd").alias("day")).agg(
        F.countDistinct("order_id").alias("orders"), F.sum("number").alias("pieces"), F.sum(F.col("number") * F.col("price")).cast("double").alias("amount")
    )


def analysis_summary(analyses: DataFrame, as_of: str) -> DataFrame:
    """One row: counts by label and risk, those of the day, mean confidence (0 when empty) and the latest day."""
    day = F.to_date(F.lit(as_of))
    risky = (F.col("label") == "negative") | (F.col("confidence") < 0.6)
    return analyses.where(~F.col("deleted")).agg(
        F.count("*").alias("total"), count_if(F.col("day") == day).alias("today"), count_if(F.col("label") == "positive").alias("positive"), count_if(F.col("label") == "neutral").alias("neutral"),
        count_if(F.col("label") == "negative").alias("negative"), count_if(F.col("confidence") < 0.6).alias("low_confidence"), count_if(risky).alias("risky"),
        F.coalesce(F.avg(F.col("confidence").cast("double")), F.lit(0.0)).alias("_mean"), F.max("day").alias("latest"),
    ).withColumn("mean_confidence", F.round("_mean", 6)).drop("_mean")


def distribution(df: DataFrame, by: str, default: str | None = None) -> DataFrame:
    """Rows by value of a column."""
    key = F.col(by) if default is None else F.coalesce(F.col(by), F.lit(default))
    return df.groupBy(key.alias(by)).agg(F.count("*").alias("total"))


def risk_trend(analyses: DataFrame, as_of: str, days: int = 6) -> DataFrame:
    """Per day since as_of less days: negative, low-confidence and all analyses. Days without rows are left out."""
    since = F.date_sub(F.to_date(F.lit(as_of)), days)
    return analyses.where((F.col("day") >= since) & ~F.col("deleted")).groupBy("day").agg(
        count_if(F.col("label") == "negative").alias("negative"), count_if(F.col("confidence") < 0.6).alias("low_confidence"), F.count("*").alias("total")
    )


def stacked(one: DataFrame, names: list[str]) -> DataFrame:
    """The columns of a one-row frame as rows (name, total)."""
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("total")) for n in names))).alias("x")).select("x.name", "x.total")


def risk_types(analyses: DataFrame) -> DataFrame:
    """Rows of each risk type; a row may count for several, and a type without rows counts 0."""
    live = ~F.col("deleted")
    one = analyses.agg(
        count_if(live & (F.col("label") == "negative")).alias("negative_review"), count_if(live & (F.col("confidence") < 0.6)).alias("low_confidence"),
        count_if(live & (F.col("negative_score") >= 0.65)).alias("after_sales_risk"),
    )
    return stacked(one, ["negative_review", "low_confidence", "after_sales_risk"])


def top_risky_products(analyses: DataFrame, k: int = 5) -> DataFrame:
    """The k products with most risky analyses and their mean confidence; ties go to the larger id."""
    risky = (F.col("label") == "negative") | (F.col("confidence") < 0.6)
    grouped = analyses.where(~F.col("deleted") & risky).groupBy("product_id").agg(F.count("*").alias("total"), F.round(F.avg(F.col("confidence").cast("double")), 6).alias("mean_confidence"))
    return grouped.orderBy(F.desc("total"), F.desc("product_id")).limit(k)


def retrieval_summary(log: DataFrame) -> DataFrame:
    """Searches, mean duration (whole, half up, 0 when empty) and searches that found nothing."""
    one = log.agg(F.count("*").alias("total"), F.sum("duration_ms").alias("ms"), count_if(F.col("found") == 0).alias("empty"))
    return one.select("total", F.coalesce(F.floor((2 * F.col("ms") + F.col("total")) / F.nullif(2 * F.col("total"), F.lit(0))), F.lit(0)).cast("bigint").alias("mean_ms"), "empty")


def evaluation_summary(runs: DataFrame) -> DataFrame:
    """Ten figures of the runs in one pass, and the number of users with repeated successful calls of one tool."""
    return runs.agg(
        F.count("*").alias("runs"), count_if(F.col("status") == "success").alias("success"), count_if(F.col("status") == "failed").alias("failed"), count_if(F.col("is_replay")).alias("replays"),
        count_if(F.col("duration_ms") > 100).alias("slow"), F.countDistinct("user_id").alias("users"), F.countDistinct("tool").alias("tools"), F.min("duration_ms").alias("fastest"),
        F.max("duration_ms").alias("slowest"), F.sum("duration_ms").alias("busy_ms"),
    )


def repeated_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than one row, and the rows they hold."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def run_trend(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per day since as_of less days: runs, success and hit rate (whole percent)."""
    since = F.date_sub(F.to_date(F.lit(as_of)), days)
    day = F.to_date("created")
    grouped = runs.where(day >= since).groupBy(F.date_format("created", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("total"), count_if(F.col("status") == "success").alias("success"))
    return grouped.withColumn("hit_rate", rate(F.col("success"), F.col("total")))


def eval_trend(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per day since as_of less days: runs, successful and failed ones."""
    kept = runs.where(F.to_date("created") >= F.date_sub(F.to_date(F.lit(as_of)), days))
    return kept.groupBy(F.date_format("created", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("total"), count_if(F.col("status") == "success").alias("success"), count_if(F.col("status") == "failed").alias("failed"))


def search_trend(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per day since as_of less days: searches (created, duration_ms, found), those with a hit, their share in percent to two
    places and the mean duration (whole, half up)."""
    kept = log.where(F.to_date("created") >= F.date_sub(F.to_date(F.lit(as_of)), days))
    grouped = kept.groupBy(F.date_format("created", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("queries"), count_if(F.col("found") > 0).alias("hits"), F.sum("duration_ms").alias("ms"))
    return grouped.select("day", "queries", "hits", whole_mean(F.col("ms"), F.col("queries")).alias("mean_ms"), percent(F.col("hits"), F.col("queries")).alias("hit_rate"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Feedback rows by type."""
    return feedback.groupBy(F.col("feedback_type").alias("name")).agg(F.count("*").alias("value"))


def evaluation_scalars(runs: DataFrame, steps: DataFrame, feedback: DataFrame, analyses: DataFrame, tasks: DataFrame) -> DataFrame:
    """The ten figures of the evaluation page as (name, value) rows: each table is aggregated once, and a duplicate group is a
    source with more than one analysis; rows without a source aren't in one."""
    def told(df: DataFrame, **figures: Column) -> DataFrame:
        one = df.agg(*(F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in figures.items()))
        return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in figures))).alias("f")).select("f.*")

    mean = whole_mean(F.sum("duration_ms"), F.count("duration_ms"))
    groups = analyses.where("source_type is not null and source_id is not null").groupBy("source_type", "source_id").agg(F.count("*").alias("c")).where("c > 1")
    kind = F.col("feedback_type")
    frames = [
        told(runs, total_runs=F.count("*"), success_runs=count_if(F.col("status") == "success"), failed_runs=count_if(F.col("status") == "failed"), mean_ms=mean), told(steps, tool_failures=count_if(F.col("status") == "failed")),
        told(feedback, feedback=F.count("*"), accepted=count_if(kind == "accept"), false_positive=count_if(kind == "false_positive")), told(groups, duplicate_groups=F.count("*")), told(tasks, pending_tasks=count_if(F.col("status") == "pending")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tool_stats(runs: DataFrame) -> DataFrame:
    """Per tool: calls, success, failures and mean duration (whole, half up)."""
    grouped = runs.groupBy("tool").agg(F.count("*").alias("total"), count_if(F.col("status") == "success").alias("success"), count_if(F.col("status") == "failed").alias("failed"), F.sum("duration_ms").alias("ms"))
    return grouped.select("tool", "total", "success", "failed", whole_mean(F.col("ms"), F.col("total")).alias("mean_ms"))


def steps_by_role(runs: DataFrame) -> DataFrame:
    """Steps by role; without one 'Unknown Agent'."""
    role = F.when(F.col("role_no") == 0, F.lit(None)).otherwise(F.concat(F.lit("role-"), F.col("role_no").cast("string")))
    return runs.groupBy(F.coalesce(role, F.lit("Unknown Agent")).alias("role")).agg(F.count("*").alias("total"))


def run_details(runs: DataFrame) -> DataFrame:
    """Per user: steps, failed ones and fallbacks (by status or by name)."""
    return runs.groupBy("user_id").agg(F.count("*").alias("steps"), count_if(F.col("status") == "failed").alias("failed"), count_if((F.col("tool") == "error") | F.col("tool").like("%sign%")).alias("fallbacks"))


def quality_summary(runs: DataFrame) -> DataFrame:
    """Ratio figures as whole percents and a warning when any lies under 70."""
    one = runs.agg(F.count("*").alias("n"), count_if(F.col("status") == "success").alias("ok"), count_if(F.col("duration_ms") <= 100).alias("quick"), count_if(~F.col("is_replay")).alias("first"))
    rates = one.select(rate(F.col("ok"), F.col("n")).alias("success_rate"), rate(F.col("quick"), F.col("n")).alias("quick_rate"), rate(F.col("first"), F.col("n")).alias("first_rate"))
    return rates.withColumn("warning", F.least("success_rate", "quick_rate", "first_rate") < 70)


def failure_groups(runs: DataFrame) -> DataFrame:
    """Counts of runs by pattern of the tool's name; patterns may overlap."""
    one = runs.agg(count_if(F.col("tool").like("%err%")).alias("errors"), count_if(F.col("tool").like("%c%")).alias("clicks"), count_if(F.col("tool").like("%zzz%")).alias("none"))
    return stacked(one, ["errors", "clicks", "none"])


def ops_summary(runs: DataFrame) -> DataFrame:
    """Success and fallback percents, mean and greatest duration, and the true 95th percentile (nearest rank)."""
    one = runs.agg(
        F.count("*").alias("total"), count_if(F.col("status") == "success").alias("ok"), count_if(F.col("is_replay")).alias("fallbacks"), F.sum("duration_ms").alias("ms"),
        F.max("duration_ms").alias("p95_compat"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").cast("bigint").alias("p95"),
    )
    return one.select(
        "total", percent(F.col("ok"), F.col("total")).alias("success_percent"), percent(F.col("fallbacks"), F.col("total")).alias("fallback_percent"),
        whole_mean(F.col("ms"), F.col("total")).alias("mean_ms"), "p95_compat", "p95",
    )


def memory_profile(analyses: DataFrame, by: str) -> DataFrame:
    """Per key: analyses, negative ones, the distinct labels joined in order, and the latest day."""
    labels = F.array_join(F.array_sort(F.collect_set("label")), ",")
    return analyses.where(~F.col("deleted")).groupBy(by).agg(F.count("*").alias("total"), count_if(F.col("label") == "negative").alias("negative"), labels.alias("labels"), F.max("day").alias("latest"))


def top_failures(runs: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent reasons of failed runs; an empty one is 'unknown'."""
    reason = F.coalesce(F.nullif(F.regexp_extract(F.col("props"), r'"k": (\d)', 1), F.lit("")), F.lit("unknown"))
    return runs.where("status = 'failed'").groupBy(reason.alias("reason")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "reason").limit(k)


def fallback_split(runs: DataFrame) -> DataFrame:
    """Rows (name, total) for fallbacks and the rest, which is never negative."""
    one = runs.agg(count_if(F.col("is_replay")).alias("fallback"), F.count("*").alias("n"))
    return stacked(one.select("fallback", F.greatest(F.col("n") - F.col("fallback"), F.lit(0)).alias("normal")), ["fallback", "normal"])


def quality_trend(trend: DataFrame) -> DataFrame:
    """Scores of a daily trend and whether the objective of 95 is met."""
    p = percent(F.col("success"), F.col("total"))
    return trend.select("day", F.floor(p * 0.9 + 10 + 0.5).cast("bigint").alias("score"), F.when(p >= 95, "healthy").otherwise("warning").alias("objective"))


def order_tabs(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Per user: unpaid, unshipped and unreceived orders, and lines of finished orders without a comment."""
    open_lines = lines.where("flag = 'N'").groupBy(F.col("order_id").alias("id")).agg(F.count("*").alias("open"))
    per = orders.where(~F.col("deleted")).join(open_lines, "id", "left")
    done = F.col("status").isin(401, 402)
    return per.groupBy("user_id").agg(
        count_if(F.col("status") == 101).alias("unpaid"), count_if(F.col("status") == 201).alias("unshipped"), count_if(F.col("status") == 301).alias("unreceived"),
        F.coalesce(F.sum(F.when(done, F.coalesce("open", F.lit(0)))), F.lit(0)).alias("uncommented"),
    )


def cart_totals(lines: DataFrame, key: str = "order_id", checked: Column | None = None) -> DataFrame:
    """Per cart: pieces and amount of all lines and of the checked ones."""
    checked = F.col("flag") == "N" if checked is None else checked
    amount = F.col("number") * F.col("price")
    return lines.where(~F.col("deleted")).groupBy(key).agg(
        F.sum("number").alias("pieces"), F.sum(amount).cast("double").alias("amount"), F.coalesce(F.sum(F.when(checked, F.col("number"))), F.lit(0)).alias("checked_pieces"),
        F.coalesce(F.sum(F.when(checked, amount)).cast("double"), F.lit(0.0)).alias("checked_amount"),
    )


def totals(**tables: DataFrame) -> DataFrame:
    """Rows (name, total), one for each table."""
    counts = [df.agg(F.count("*").alias("total")).select(F.lit(name).alias("name"), "total") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def comment_counts(analyses: DataFrame) -> DataFrame:
    """Per product: comments, and those with a picture (a link in the text)."""
    return analyses.where(~F.col("deleted")).groupBy("product_id").agg(F.count("*").alias("total"), count_if(F.col("text").contains("http")).alias("with_picture"))


def open_tasks(orders: DataFrame, closed: list[int]) -> DataFrame:
    """Rows whose status isn't closed."""
    return orders.agg(count_if(~F.col("status").isin(closed)).alias("open_tasks"), F.count("*").alias("all_tasks"))


def spec_groups(lines: DataFrame) -> DataFrame:
    """Per order: line flags in order of the lines, joined."""
    listed = F.sort_array(F.collect_list(F.struct("line_no", "flag")))
    return lines.groupBy("order_id").agg(F.array_join(F.transform(listed, lambda x: x["flag"]), ",").alias("flags"))


def coupon_caps(received: DataFrame, coupons: DataFrame) -> DataFrame:
    """Coupons that can still be had: fewer received than their total, 0 meaning no limit."""
    counted = received.groupBy("coupon_id").agg(F.count("*").alias("received"))
    both = coupons.join(counted, "coupon_id", "left").withColumn("received", F.coalesce("received", F.lit(0)))
    return both.select("coupon_id", "total", "received", ((F.col("total") == 0) | (F.col("received") < F.col("total"))).alias("available"))


def members_joined(events: DataFrame, size: int) -> DataFrame:
    """Per group: members with the founder, and whether one more fills it."""
    grouped = events.groupBy("group_id").agg((F.countDistinct("user_id") + 1).alias("members"))
    return grouped.withColumn("full", F.col("members") >= size - 1)


def histogram(values: DataFrame, by: str, value: str) -> DataFrame:
    """Per key: count, min, max and the values at index round((n - 1) * p), half even, for p = .5 and .95.

    Equal values are counted before they are moved; the running count over a key's different values tells which one
    stands at an index."""
    counted = values.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    placed = counted.withColumns({"_n": F.sum("_c").over(w), "_upto": F.sum("_c").over(w.orderBy(value))})
    at = lambda p: F.min(F.when(F.col("_upto") > F.bround((F.col("_n") - 1) * F.lit(p), 0), F.col(value)))
    return placed.groupBy(by).agg(F.sum("_c").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def nearest_rank(values: DataFrame, by: str, value: str, p: float = 0.95) -> DataFrame:
    """Per key the nearest-rank percentile."""
    return values.groupBy(by).agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("bigint").alias("p95"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(expected, predicted, high booleans) -> the confusion matrix and its ratios, 0.0 on empty denominators."""
    e, p, h = F.col("expected"), F.col("predicted"), F.col("high")
    one = pairs.agg(
        count_if(e & p).alias("tp"), count_if(~e & p).alias("fp"), count_if(~e & ~p).alias("tn"), count_if(e & ~p).alias("fn"), count_if(h).alias("_h"), count_if(h & p).alias("_hp"), F.count("*").alias("_n")
    )
    precision, recall = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return one.select(
        "tp", "fp", "tn", "fn", F.round(safe_div(F.col("tp") + F.col("tn"), F.col("_n")), 6).alias("accuracy"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(safe_div(2 * precision * recall, precision + recall), 6).alias("f1"), F.round(safe_div(F.col("_hp"), F.col("_h")), 6).alias("high_recall"),
        F.round(safe_div(F.col("tp") + F.col("fp"), F.col("_n")), 6).alias("trigger_rate"), F.round(safe_div(F.col("fn"), F.col("_n")), 6).alias("unsafe_pass_rate"),
    )


def macro_f1(pairs: DataFrame) -> DataFrame:
    """(truth, said) -> classes and the mean F1 over the classes of both."""
    both = pairs.select(F.explode(F.array_distinct(F.array("truth", "said"))).alias("c"), "truth", "said")
    per = both.groupBy("c").agg(count_if((F.col("truth") == F.col("c")) & (F.col("said") == F.col("c"))).alias("tp"), F.count("*").alias("any"))
    return per.agg(F.count("*").alias("classes"), F.round(F.avg(2 * F.col("tp") / (F.col("any") + F.col("tp"))), 6).alias("macro_f1"))


def label_divergence(counts_a: DataFrame, counts_b: DataFrame) -> DataFrame:
    """(key, n) twice -> Jensen-Shannon divergence in nats of the two distributions, and the dominant share of the first."""
    a = counts_a.select("key", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    b = counts_b.select("key", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("q"))
    both = a.join(b, "key", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    part = lambda x, y: F.when(x > 0, x * F.ln(2 * x / (x + y))).otherwise(0.0)
    return both.agg(F.round(F.sum(part(F.col("p"), F.col("q")) + part(F.col("q"), F.col("p"))) / 2, 6).alias("divergence"), F.round(F.max("p"), 6).alias("dominant_share"))


def agreement(first: DataFrame, second: DataFrame, fields: list[str]) -> DataFrame:
    """Share of requests in both sets whose fields agree, and of those where all do."""
    both = first.alias("a").join(second.alias("b"), "id")
    same = [F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields]
    every = same[0]
    for s in same[1:]:
        every = every & s
    return both.agg(F.count("*").alias("n"), *(F.round(F.avg(s.cast("double")), 6).alias(f"same_{f}") for s, f in zip(same, fields, strict=True)), F.round(F.avg(every.cast("double")), 6).alias("same_all"))


def least_price(goods: DataFrame, prices: DataFrame) -> DataFrame:
    """Per goods: the smallest price, and 2147483647 where there is none."""
    return goods.join(prices.groupBy("goods_id").agg(F.min("price").alias("p")), "goods_id", "left").select("goods_id", F.coalesce(F.col("p").cast("double"), F.lit(2147483647.0)).alias("price"))

"""Review scoring: lexicon, image and rating signals, fusion, conflict, risk decisions, tasks and routing, all as
column expressions over one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import clamp


def hits(text: Column, words: Sequence[str]) -> Column:
    """The words that a text contains, in lexicon order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def text_signal(df: DataFrame, positive: Sequence[str], negative: Sequence[str], risk: Sequence[str], text: str = "text", rating: str = "rating") -> DataFrame:
    """Adds text_score, text_label, evidence and text_confidence. The label uses the unrounded score; the confidence
    counts all evidence before the first five are kept."""
    df = df.withColumns({"_p": hits(F.col(text), positive), "_n": hits(F.col(text), negative), "_r": hits(F.col(text), risk)})
    base = F.coalesce(F.col(rating) / 5.0, F.lit(0.6))
    df = df.withColumn("_score", clamp((base + 0.5 + 0.08 * F.size("_p") - 0.1 * F.size("_n")) / 2, 0.05, 0.98))
    label = F.when((F.col("_score") >= 0.68) & (F.size("_n") <= 1), "positive").when((F.col("_score") <= 0.42) | (F.size("_r") > 0), "negative").otherwise("neutral")
    found = F.concat("_p", "_n", "_r")
    shown = F.when(F.size(found) > 0, F.slice(found, 1, 5)).otherwise(F.array(F.substring(text, 1, 20)))
    return df.withColumns({"text_score": F.round("_score", 4), "text_label": label, "evidence": shown, "text_confidence": F.round(F.least(F.lit(0.95), 0.68 + 0.05 * F.greatest(F.size(found), F.lit(1))), 4)}).drop("_p", "_n", "_r", "_score")


def image_score(urls: Column) -> Column:
    """0.5 without images; more for valid ones, less when one isn't a link."""
    valid = F.size(F.filter(urls, lambda u: u.rlike("^https?://")))
    return F.when(F.coalesce(F.size(urls), F.lit(0)) <= 0, F.lit(0.5)).otherwise(F.round(clamp(0.64 + 0.04 * F.least(valid, F.lit(3)) - F.when(valid < F.size(urls), 0.08).otherwise(0.0), 0.05, 0.98), 4))


#: Words in image links that tell of damage or after-sales cases, and the most that the image then scores.
IMAGE_RISK, IMAGE_RISK_CAP = ("broken", "damage", "refund", "after-sales", "crack", "defect", "破损", "退款", "售后"), 0.28


def image_risk(score: Column, urls: Column) -> Column:
    """The image score, capped where a link holds a risk word."""
    joined = F.lower(F.array_join(urls, " "))
    hit = F.lit(False)
    for w in IMAGE_RISK:
        hit = hit | F.coalesce(joined.contains(w), F.lit(False))
    return F.when(hit, F.least(score, F.lit(IMAGE_RISK_CAP))).otherwise(score)


def rating_signal(rating: Column) -> tuple[Column, Column]:
    """A rating's score, .6 without one, and its label."""
    score = F.when(rating.isNotNull(), clamp(rating / 5.0, 0.05, 0.95)).otherwise(0.6)
    return F.round(score, 4), F.when(score >= 0.7, "positive").when(score <= 0.4, "negative").otherwise("neutral")


def conflict(text: Column, image: Column, rating: Column, least: float = 0.35) -> tuple[Column, Column]:
    """Which pairs of signals differ by least or more, and the largest difference."""
    pairs = {"text_rating_conflict": F.abs(text - rating), "text_image_conflict": F.abs(text - image), "rating_image_conflict": F.abs(rating - image)}
    return F.array_compact(F.array(*(F.when(d >= least, F.lit(n)) for n, d in pairs.items()))), F.round(F.greatest(*pairs.values()), 4)


def dominant(text: Column, image: Column, rating: Column) -> Column:
    """The signal farthest from 0.5; ties in the order text, image, rating."""
    t, i, r = (F.abs(x - 0.5) for x in (text, image, rating))
    return F.when((t >= i) & (t >= r), "text").when(i >= r, "image").otherwise("rating")


def final_confidence(text: Column, image: Column, rating: Column, difference: Column) -> Column:
    far = F.round(2 * F.greatest(F.abs(text - 0.5), F.abs(image - 0.5), F.abs(rating - 0.5)), 4)
    return F.round(clamp(0.78 - 0.45 * difference + 0.1 * far, 0.35, 0.95), 4)


def needs_review(difference: Column, confidence: Column) -> Column:
    """Whether the signals disagree too much or leave too little confidence."""
    return (difference >= 0.35) | (confidence < 0.55)


def risk_types(risk_hits: Column, conflicts: Column, review: Column) -> Column:
    """Risk words, then modality_conflict and low_confidence where they hold."""
    return F.concat(risk_hits, F.array_compact(F.array(F.when(F.size(conflicts) > 0, F.lit("modality_conflict")), F.when(review, F.lit("low_confidence")))))


def risk_level(types: Column, label: Column, risk_hits: Column) -> Column:
    """high for a modality conflict or a risk word, medium for other types or a negative label, else low."""
    return F.when(F.array_contains(types, "modality_conflict") | (F.size(risk_hits) > 0), "high").when((F.size(types) > 0) | (label == "negative"), "medium").otherwise("low")


def plain_risk_level(risk_hits: Column, difference: Column, label: Column) -> Column:
    """high for a risk word, medium for a conflict or a negative label, else low."""
    return F.when(F.size(risk_hits) > 0, "high").when((difference >= 0.35) | (label == "negative"), "medium").otherwise("low")


def fallback_risk_type(text: Column, after_sales: Sequence[str], difference: Column, confidence: Column, label: Column) -> Column:
    """The first rule that fits, in this order."""
    return (
        F.when(F.size(hits(F.lower(text), after_sales)) > 0, "after_sales_risk").when(difference >= 0.35, "modality_conflict")
        .when(confidence < 0.6, "low_confidence").when(label == "negative", "negative_review").otherwise("normal_review")
    )


def fused(text: Column, image: Column, rating: Column | None = None) -> Column:
    """Weighted fusion: with the rating .62, .20, .18, else .72, .28."""
    return F.round(0.72 * text + 0.28 * image, 4) if rating is None else F.round(0.62 * text + 0.2 * image + 0.18 * rating, 4)


def three_way(score: Column, label: Column, floor: float = 0.72) -> tuple[Column, Column, Column]:
    """Positive, neutral and negative scores; the label's own is at least floor, any other label counts as neutral."""
    raised = lambda c, own: F.when(own, F.greatest(c, F.lit(floor))).otherwise(c)
    is_positive, is_negative = (F.coalesce(label == x, F.lit(False)) for x in ("positive", "negative"))
    positive = raised(clamp(score, 0.05, 0.95), is_positive)
    neutral = raised(clamp(1 - F.abs(score - 0.5) * 2, 0.05, 0.95), ~is_positive & ~is_negative)
    negative = raised(clamp(1 - score, 0.05, 0.95), is_negative)
    return F.round(positive, 4), F.round(neutral, 4), F.round(negative, 4)


def suggestion(level: Column, label: Column) -> tuple[Column, Column]:
    """Action and priority."""
    action = F.when(level == "high", "urgent_follow_up").when(label == "negative", "after_sales_follow_up").otherwise("observe_and_optimize")
    return action, F.when(level == "high", "high").when(label == "negative", "medium").otherwise(level)


def route_labels(level: Column, kind: Column, consistency: Column, visual_status: Column, confidence: Column) -> tuple[Column, Column, Column]:
    """Whether labels ask for a review, whether the route should have predicted one, and whether the case is high-risk."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    expected = low(level).isin("medium", "high") | ~low(kind).isin("", "normal_review")
    predicted = expected | low(visual_status).isin("failed", "timeout", "oom", "unavailable") | low(consistency).isin("conflicting", "uncertain") | F.coalesce(confidence < 0.7, F.lit(False))
    return expected, predicted, (low(level) == "high") | (low(kind) == "after_sales_risk")


def route(level: Column, status: Column, evidence: Column, top_score: Column, confidence: Column) -> tuple[Column, Column]:
    """The first rule that fits gives route and reason."""
    enough = (F.size(evidence) > 0) & (top_score > 0) & (status == "success")
    to = F.when(level == "high", "human_review").when(status != "success", "fallback_human_review").when(F.size(evidence) == 0, "human_review").when((level == "medium") & (top_score < 0.35), "human_review")
    why = F.when(level == "high", "high_risk").when(status != "success", "tool_failed").when(F.size(evidence) == 0, "no_evidence").when((level == "medium") & (top_score < 0.35), "low_retrieval_score")
    advice = (level == "low") & (confidence >= 0.75) & enough
    return to.when(advice, "operation_advice").otherwise("human_review"), why.when(advice, "none").otherwise("confidence_or_evidence")


def high_risk(label: Column, confidence: Column, negative: Column, rating: Column) -> Column:
    """The patrol's test; a missing value doesn't count."""
    return F.coalesce(label == "negative", F.lit(False)) | F.coalesce(confidence < 0.6, F.lit(False)) | F.coalesce(negative >= 0.65, F.lit(False)) | F.coalesce(rating <= 2, F.lit(False))


def risk_tasks(analyses: DataFrame, after_sales: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """One task per analysis and risk type, the first rule of a type winning; running it again gives the same tasks. Columns
    kept follow."""
    def task(kind: str, level: str) -> Column:
        return F.struct(F.lit(kind).alias("risk_type"), F.lit(level).alias("risk_level"))

    contains = F.lit(False)
    for w in after_sales:
        contains = contains | F.col("text").contains(w)
    negative = F.coalesce(F.col("label") == "negative", F.lit(False))
    rules = F.array_compact(F.array(
        F.when(negative, task("negative_review", "high")), F.when(F.col("confidence").isNull() | (F.col("confidence") < 0.6), task("low_confidence", "medium")),
        F.when(F.col("negative_score") >= 0.65, task("after_sales_risk", "high")), F.when((F.col("rating") <= 2) & ~negative, task("rating_conflict", "medium")), F.when(contains, task("after_sales_risk", "high")),
    ))
    return analyses.select(F.col("id").alias("analysis_id"), *kept, F.explode(F.array_distinct(rules)).alias("t")).select("analysis_id", "t.risk_type", "t.risk_level", F.lit("pending").alias("status"), *kept)


#: Reason codes of a human review in order; each but HIGH_RISK and LOW_CONFIDENCE is a flag of its name.
REVIEW_REASONS = (
    "HIGH_RISK", "EVIDENCE_CONFLICT", "INSUFFICIENT_EVIDENCE", "UNSUPPORTED_CLAIM", "FALLBACK_USED", "PROMPT_INJECTION",
    "PROHIBITED_ACTION", "SCHEMA_REPEATED_FAILURE", "TOOL_FAILURE", "LOW_CONFIDENCE", "RISK_LEVEL_CONFLICT",
)


def review_reasons(level: Column, confidence: Column, flags: dict[str, Column]) -> Column:
    """Codes for a human review in order: HIGH_RISK by level, LOW_CONFIDENCE under .65, the others by their flags. No code
    means that no review is needed; a missing flag or confidence doesn't count."""
    unknown = set(flags) - set(REVIEW_REASONS)
    if unknown:
        raise ValueError(f"no such reason: {sorted(unknown)}")
    told = {"HIGH_RISK": level == "high", "LOW_CONFIDENCE": confidence < 0.65} | flags
    return F.array_compact(F.array(*(F.when(F.coalesce(told[c], F.lit(False)), F.lit(c)) for c in REVIEW_REASONS if c in told)))


def base_level(text: Column, rating: Column, after_sales: Sequence[str], negative: Sequence[str]) -> Column:
    return F.when(F.size(hits(text, after_sales)) > 0, "high").when((rating <= 2) | (F.size(hits(text, negative)) > 0), "medium").otherwise("low")


def gate(requirements: dict[str, Column]) -> tuple[Column, Column]:
    """Names of the requirements that fail, and the status."""
    blockers = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in requirements.items())))
    return blockers, F.when(F.size(blockers) == 0, "ready").otherwise("blocked")

"""Document governance: chunks, ids, evidence checks, contract extraction and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.text import LINE_END, SPACES, chunk_tokens, content_id, plain_spaces, token_count, token_windows


def chunks(docs: DataFrame, size: int = 220, overlap: int = 48, joiner: str = "") -> DataFrame:
    """(id, text) -> id, nth, n_tokens, content, chunk_id: sliding windows of tokens with a step of size - overlap. Windows
    at the end are kept though they are covered; a text without tokens gives one empty chunk; tokens are joined without
    spaces unless a joiner is given, as ids hash that text."""
    listed = docs.select("id", chunk_tokens(F.col("text")).alias("_t"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_t") - 1, F.lit(0)), F.lit(size - overlap))
    windows = listed.select("id", "_t", F.posexplode(starts).alias("nth", "_s"))
    cut = F.slice("_t", F.col("_s") + 1, F.lit(size))
    out = windows.select("id", "nth", F.size(cut).alias("n_tokens"), F.array_join(cut, joiner).alias("content"))
    return out.withColumn("chunk_id", content_id(F.col("id").cast("string"), F.col("nth").cast("string"), F.col("content")))


def sectioned(docs: DataFrame) -> DataFrame:
    """(id, version, text) -> id, version, sections: array of (heading, body). A line that starts with # after spaces opens a
    section under its own words, or "root" where it has none; lines before the first heading are under "root" too. A heading
    without lines gives no section; a text of which nothing is left (empty, null, headings only) is one section, whole, and
    so is one without any #, of which no lines are made.
    The work stays in the row: headings are positions in the array of lines, sections the slices between two of them."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("id", "version", text.alias("_text"), F.when(F.contains(text, F.lit("#")), F.split(text, LINE_END)).alias("_l"))
    lines = lines.withColumn("_l", F.when(F.element_at("_l", -1) == "", F.slice("_l", 1, F.size("_l") - 1)).otherwise(F.col("_l")))
    opens = F.transform("_l", lambda line, i: F.when(F.startswith(F.ltrim(line, F.lit(SPACES)), F.lit("#")), i))
    marked = lines.withColumn("_h", F.filter(opens, lambda i: i.isNotNull()))
    words = lambda i: F.btrim(F.btrim(F.get("_l", i), F.lit("# ")), F.lit(SPACES))  # noqa: E731  null before the first heading
    between = F.zip_with(
        F.concat(F.array(F.lit(-1)), "_h"), F.concat("_h", F.array(F.size("_l"))),
        lambda a, b: F.struct(F.coalesce(F.nullif(words(a), F.lit("")), F.lit("root")).alias("heading"), F.slice("_l", a + 2, b - a - 1).alias("lines")),
    )
    kept = marked.withColumn("_s", F.filter(between, lambda s: F.size(s["lines"]) > 0))
    joined = F.transform("_s", lambda s: F.struct(s["heading"].alias("heading"), F.array_join(s["lines"], "\n").alias("body")))
    whole = F.array(F.struct(F.lit("root").alias("heading"), F.col("_text").alias("body")))
    return kept.select("id", "version", F.when(F.size("_s") > 0, joined).otherwise(whole).alias("sections"))


def hierarchical_chunks(docs: DataFrame, parent: int = 700, child: int = 220, overlap: int = 48, joiner: str = "", repeat_parents: bool = True) -> DataFrame:
    """(id, version, text) -> id, nth, heading, n_tokens, content, parent_id, parent_content, chunk_id: sections are cut into
    parents of so many tokens, parents into children that overlap; neither crosses a heading. nth runs through the document;
    a parent's id hashes its text and the nth of its first child, a child's id its own nth and the hash of its text. A
    section without tokens is one empty child of one empty parent. With repeat_parents off only a parent's first child has
    parent_content. Rows don't shuffle."""
    if child <= overlap:
        raise ValueError("a child must be longer than the overlap")
    step = child - overlap
    joined = lambda t: F.array_join(chunk_tokens(t), joiner) if joiner else F.replace(t, F.lit(" "), F.lit(""))
    parents = F.flatten(F.transform("sections", lambda s: F.transform(token_windows(plain_spaces(s["body"]), parent, parent), lambda w: F.struct(s["heading"].alias("heading"), joined(w).alias("text"), token_windows(w, child, step).alias("windows")))))
    # Only the last window of a parent is counted; what the others hold follows from it.
    counted = F.transform(parents, lambda p: F.struct(p["heading"].alias("heading"), p["text"].alias("text"), p["windows"].alias("windows"), ((F.size(p["windows"]) - 1) * step + token_count(F.element_at(p["windows"], -1))).alias("n")))
    children = F.flatten(F.transform(counted, lambda p: F.transform(p["windows"], lambda w, i: F.struct(p["heading"].alias("heading"), p["text"].alias("text"), i.alias("i"), F.least(F.lit(child), p["n"] - i * step).alias("n"), joined(w).alias("content")))))
    out = sectioned(docs).select("id", "version", F.posexplode(children).alias("nth", "_c"))
    digest = lambda *parts: F.substring(F.sha2(F.concat_ws(":", "id", "version", *parts), 256), 1, 24)
    return out.select(
        "id", "nth", F.col("_c.heading").alias("heading"), F.col("_c.n").alias("n_tokens"), F.col("_c.content").alias("content"),
        digest(F.lit("parent"), F.col("nth") - F.col("_c.i"), F.col("_c.text")).alias("parent_id"), (F.col("_c.text") if repeat_parents else F.when(F.col("_c.i") == 0, F.col("_c.text"))).alias("parent_content"),
        digest(F.col("nth"), F.sha2("_c.content", 256)).alias("chunk_id"),
    )


def verify_evidence(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """claims (id, evidence array, level), texts (id, text, trusted) -> verified and rejected pieces, coverage, codes and
    whether a review is needed. Without evidence coverage is 0, which asks for a review."""
    joined = claims.join(texts, "id", "left")
    good = F.filter("evidence", lambda e: F.coalesce(F.contains(F.col("text"), e), F.lit(False)))
    n = F.size("evidence")
    codes = F.array_compact(F.array(
        F.when(F.col("text").isNull(), "EMPTY_RETRIEVAL"), F.when(F.size(good) < n, "EVIDENCE_NOT_FOUND"), F.when((F.col("level") == "high") & ~F.coalesce("trusted", F.lit(False)), "LOW_TRUST_HIGH_RISK"),
    ))
    coverage = F.when(F.col("text").isNull(), 0.0).otherwise(F.round(F.size(good) / F.greatest(n, F.lit(1)), 6))
    return joined.select("id", F.size(good).alias("verified"), (n - F.size(good)).alias("rejected"), coverage.alias("coverage"), F.array_join(codes, ",").alias("codes"), ((F.size(codes) > 0) | (coverage < 1)).alias("review"))


def extract_json(text: Column) -> tuple[Column, Column]:
    """The outermost JSON object of a messy text, and the steps taken, in order: byte-order mark, think block, fence, text
    around the object, trailing commas."""
    steps = []
    t = F.regexp_replace(text, "^﻿", "")
    cleaned = F.regexp_replace(t, r"(?s)<think>.*?</think>", "")
    steps.append(F.when(cleaned != t, "think_block_removed"))
    t = cleaned
    cleaned = F.regexp_replace(t, r"(?s)```(?:json)?", "")
    steps.append(F.when(cleaned != t, "markdown_fence_removed"))
    t = F.trim(F.regexp_replace(cleaned, r"^\s+|\s+$", ""))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    steps.append(F.when((inner != "") & (inner != t), "extra_text_removed"))
    commas = F.regexp_replace(inner, r",\s*([}\]])", "$1")
    steps.append(F.when(commas != inner, "trailing_comma_removed"))
    steps.append(F.when(inner == "", "json_object_not_found"))
    return F.nullif(commas, F.lit("")), F.array_join(F.array_compact(F.array(*steps)), ",")


#: The closed lists of the decision contract.
RISK_TYPES, RISK_LEVELS = ("normal_review", "negative_review", "after_sales_risk"), ("low", "medium", "high")


def normalise_decision(json: Column) -> dict[str, Column]:
    """Fields of a decision with aliases resolved, enums lower-cased, booleans from strings, and whether it is eligible:
    required fields are never made up."""
    field = lambda *names: F.coalesce(*(F.get_json_object(json, f"$.{n}") for n in names))
    kind, level = F.lower(field("risk_type", "riskType")), F.lower(field("risk_level", "riskLevel"))
    review = F.lower(field("need_human_review", "human_review_required"))
    reason = field("route_reason", "routeReason")
    ok = kind.isin(*RISK_TYPES) & level.isin(*RISK_LEVELS) & review.isin("true", "false") & (F.length(reason) > 0)
    return {"risk_type": kind, "risk_level": level, "need_human_review": review == "true", "route_reason": reason, "eligible": F.coalesce(ok, F.lit(False))}

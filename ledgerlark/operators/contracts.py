"""The decision contract: extraction, normalisation, fallback, failure reasons and repair of model outputs, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import clamp

#: The closed lists of the contract, its fields, and what else they are called.
RISK_TYPES, RISK_LEVELS = ("normal_review", "negative_review", "after_sales_risk"), ("low", "medium", "high")
SENTIMENTS = ("positive", "neutral", "negative")
REQUIRED = ("risk_type", "risk_level", "text_evidence", "need_human_review", "route_reason", "missing_information", "unsupported_claims")
OPTIONAL = ("schema_version", "visual_evidence", "retrieved_case_evidence")
LISTS = ("text_evidence", "visual_evidence", "missing_information", "unsupported_claims")
ALIASES = {"riskType": "risk_type", "riskLevel": "risk_level", "human_review_required": "need_human_review", "needHumanReview": "need_human_review", "evidence": "text_evidence"}
#: Words of actions that a model must not take on its own.
PROHIBITED = ("refund", "ban", "compensate", "自动退款", "自动封禁", "自动赔付")


def with_extraction(df: DataFrame, text: str = "output") -> DataFrame:
    """Adds json (the outermost object of the text, null if there is none that parses), steps and failure."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x{feff} \t\r\n]+|[\x{feff} \t\r\n]+$", "")
    df = df.withColumn("_0", t).withColumn("_think", F.col("_0").rlike(r"(?is)<think>.*?</think>"))
    df = df.withColumn("_1", F.when(F.col("_think"), F.regexp_replace(F.regexp_replace("_0", r"(?is)<think>.*?</think>", ""), r"^\s+|\s+$", "")).otherwise(F.col("_0")))
    df = df.withColumn("_fence", F.startswith("_1", F.lit("```")))
    bare = F.regexp_replace(F.regexp_replace("_1", r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    df = df.withColumn("_2", F.when(F.col("_fence"), bare).otherwise(F.col("_1")))
    df = df.withColumns({"_a": F.regexp_extract("_2", r"(?s)^([^{]*)\{", 1), "_b": F.regexp_extract("_2", r"(?s)\}([^}]*)$", 1), "_c": F.regexp_extract("_2", r"(?s)\{.*\}", 0)})
    df = df.withColumn("_d", F.regexp_replace("_c", r",\s*([}\]])", "$1"))
    parses = lambda c: F.coalesce(F.try_parse_json(c).isNotNull(), F.lit(False))
    there = F.col("_c") != ""
    df = df.withColumns({"_ok": there & parses(F.col("_c")), "_late": there & ~parses(F.col("_c")) & (F.col("_d") != F.col("_c")) & parses(F.col("_d"))})
    steps = F.array_compact(F.array(
        F.when(F.col("_think"), "think_block_removed"), F.when(F.col("_fence"), "markdown_fence_removed"), F.when(there & (F.trim("_a") != ""), "extra_text_before_json_removed"),
        F.when(there & (F.trim("_b") != ""), "extra_text_after_json_removed"), F.when(F.col("_late"), "trailing_comma_removed"),
    ))
    failure = F.when(~there, "json_object_not_found").when(~F.col("_ok") & ~F.col("_late"), "json_syntax_error")
    out = df.withColumns({"json": F.when(F.col("_ok"), F.col("_c")).when(F.col("_late"), F.col("_d")), "steps": steps, "failure": failure})
    return out.drop("_0", "_1", "_2", "_a", "_b", "_c", "_d", "_think", "_fence", "_ok", "_late")


def _kind(name: str) -> Column:
    """The JSON type of a field of the column v; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))


def _text(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "string")


def with_normalised(df: DataFrame, json: str = "json") -> DataFrame:
    """Adds the decision's fields, operations, warnings and valid. Required fields are never made up: a decision without
    one, with one of another type, with a value outside the closed lists or with an unknown field is not valid. Where a
    field comes under two names, the contract's own wins."""
    df = df.withColumns({"v": F.try_parse_json(json), "_keys": F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))})
    has = lambda k: F.array_contains("_keys", k)
    names = {f: [f, *(a for a, t in ALIASES.items() if t == f)] for f in (*REQUIRED, *OPTIONAL)}
    kind = {f: F.coalesce(*(F.when(has(n), F.coalesce(_kind(n), F.lit("VOID"))) for n in ns)) for f, ns in names.items()}
    text = {f: F.coalesce(*(F.when(has(n), _text(n)) for n in ns)) for f, ns in names.items()}
    is_text = {f: F.coalesce(kind[f] == "STRING", F.lit(False)) for f in names}
    df = df.withColumns({f"_k_{f}": kind[f] for f in names} | {f"_t_{f}": F.when(is_text[f] | (kind[f] == "BOOLEAN"), text[f]) for f in ("risk_type", "risk_level", "need_human_review", "route_reason")})
    k = lambda f: F.col(f"_k_{f}")
    ops = [F.when(has(a), F.lit(f"field_alias:{a}->{t}")) for a, t in ALIASES.items()] + [F.when(~has("schema_version"), F.lit("schema_version_added"))]
    warnings, fields = [], {}
    for f, allowed in (("risk_type", RISK_TYPES), ("risk_level", RISK_LEVELS)):
        raw = F.when(k(f) == "STRING", F.col(f"_t_{f}"))
        cased = ~raw.isin(*allowed) & F.lower(raw).isin(*allowed)
        fields[f] = F.when(cased, F.lower(raw)).otherwise(raw)
        ops.append(F.when(cased, F.lit(f"enum_case_normalized:{f}")))
        warnings.append(F.when(~raw.isin(*allowed) & ~cased, F.concat(F.lit(f"invalid_enum:{f}:"), raw)))
    said = F.lower("_t_need_human_review")
    word = F.coalesce(k("need_human_review") == "STRING", F.lit(False)) & said.isin("true", "false")
    fields["need_human_review"] = F.when(said.isin("true", "false"), said == "true")
    ops.append(F.when(word, F.lit("boolean_string_normalized:need_human_review")))
    warnings.append(F.when((k("need_human_review") == "STRING") & ~word, F.concat(F.lit("invalid_boolean:need_human_review:"), "_t_need_human_review")))
    ops += [F.when(k(f) == "STRING", F.lit(f"string_to_list:{f}")) for f in LISTS]
    fields["route_reason"] = F.when(k("route_reason") == "STRING", F.col("_t_route_reason"))
    ops.append(F.when(k("retrieved_case_evidence") == "ARRAY<STRING>", F.lit("retrieved_case_string_to_object")))
    listed = lambda f: k(f).isin("STRING", "ARRAY<STRING>", "ARRAY<VOID>")
    ok = fields["risk_type"].isin(*RISK_TYPES) & fields["risk_level"].isin(*RISK_LEVELS) & fields["need_human_review"].isNotNull() & (F.length(fields["route_reason"]) > 0)
    ok = ok & listed("text_evidence") & listed("missing_information") & listed("unsupported_claims") & (k("visual_evidence").isNull() | listed("visual_evidence"))
    ok = ok & (k("retrieved_case_evidence").isNull() | k("retrieved_case_evidence").rlike("^ARRAY<(STRING|VOID|OBJECT<case_id: STRING, reason: STRING>)>$")) & (k("schema_version").isNull() | (k("schema_version") == "STRING"))
    ok = F.coalesce(ok & (F.size(F.array_except("_keys", F.array(*map(F.lit, (*REQUIRED, *OPTIONAL, *ALIASES))))) == 0), F.lit(False))
    warnings.append(F.when(~ok, F.lit("canonical_validation_failed")))
    out = df.withColumns(fields | {"operations": F.array_compact(F.array(*ops)), "warnings": F.array_compact(F.array(*warnings)), "valid": ok})
    return out.drop("v", "_keys", *(f"_k_{f}" for f in names), "_t_risk_type", "_t_risk_level", "_t_need_human_review", "_t_route_reason")


def processed(outputs: DataFrame, text: str = "output") -> DataFrame:
    """Decisions of raw outputs: eligible ones as they are, and a safe fallback, which asks for a review, for the others."""
    df = with_normalised(with_extraction(outputs, text))
    eligible = F.col("failure").isNull() & F.col("valid")
    reason = F.coalesce("failure", F.array_join("warnings", ";"))
    pick = lambda c, other: F.when(eligible, F.col(c)).otherwise(other)
    source = F.when(~eligible, "operational_safety_fallback").when(F.size("operations") > 0, "contract_normalization").otherwise("raw_model")
    return df.select(
        *(c for c in outputs.columns if c != text), F.col("failure").isNull().alias("extracted"), F.array_join("steps", ",").alias("steps"), F.when(F.col("failure").isNull(), F.array_join("operations", ",")).alias("operations"), eligible.alias("eligible"), (~eligible).alias("abstained"),
        pick("risk_type", F.lit("normal_review")).alias("risk_type"), pick("risk_level", F.lit("low")).alias("risk_level"), pick("need_human_review", F.lit(True)).alias("need_human_review"),
        pick("route_reason", F.concat(F.lit("Model output could not be verified: "), reason)).alias("route_reason"), source.alias("source"),
    )


def failure_reasons(df: DataFrame, text: str = "output") -> DataFrame:
    """Adds reasons: why a raw output isn't a canonical decision as it stands, sorted; none for one that is."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"_t": t, "_c": F.regexp_extract(t, r"(?s)\{.*\}", 0)})
    df = df.withColumns({"v": F.try_parse_json("_c"), "_keys": F.coalesce(F.json_object_keys("_c"), F.array().cast("array<string>")), "_a": F.regexp_extract("_t", r"(?s)^([^{]*)\{", 1), "_b": F.regexp_extract("_t", r"(?s)\}([^}]*)$", 1)})
    has = lambda k: F.array_contains("_keys", k)
    there, parsed = F.col("_c") != "", F.col("v").isNotNull()
    out = [
        F.when(F.contains("_t", F.lit("```")), "markdown_wrapper_present"), F.when(F.col("_t").rlike("(?i)<think>|</think>"), "think_tag_present"), F.when(~there, "json_object_not_found"),
        F.when(there & (F.trim("_a") != ""), "extra_text_before_json"), F.when(there & (F.trim("_b") != ""), "extra_text_after_json"), F.when(there & ~parsed, "json_syntax_error"),
    ]
    for f, allowed in (("risk_type", RISK_TYPES), ("risk_level", RISK_LEVELS)):
        bad = has(f) & (_kind(f) == "STRING") & ~_text(f).isin(*allowed)
        out.append(F.when(bad, F.when(F.lower(_text(f)).isin(*allowed), "enum_case_mismatch").when(_text(f).rlike(r"[\x{4e00}-\x{9fff}]"), "enum_language_mismatch").otherwise("enum_value_invalid")))
    odd = has("need_human_review") & (_kind("need_human_review") != "BOOLEAN")
    out.append(F.when(odd, F.when((_kind("need_human_review") == "STRING") & F.lower(_text("need_human_review")).isin("true", "false"), "boolean_as_string").otherwise("wrong_scalar_type")))
    for f in (*LISTS, "retrieved_case_evidence"):
        kind = F.coalesce(_kind(f), F.lit("VOID"))
        items = F.when(~kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), "evidence_item_shape_invalid") if f in LISTS else F.lit(None).cast("string")
        out.append(F.when(has(f), F.when(kind == "VOID", "null_not_allowed").when(~F.startswith(kind, F.lit("ARRAY")), "list_expected").otherwise(items)))
    out.append(F.when(has("route_reason") & (_kind("route_reason") != "STRING"), "wrong_scalar_type"))
    missing = F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), "_keys")) > 0
    unknown = F.size(F.array_except("_keys", F.array(*map(F.lit, (*REQUIRED, *OPTIONAL))))) > 0
    alias = F.size(F.array_intersect("_keys", F.array(*map(F.lit, ALIASES)))) > 0
    out += [F.when(parsed & missing, "missing_required_field"), F.when(parsed & unknown, "unknown_field"), F.when(parsed & alias, "wrong_field_alias")]
    return df.withColumn("reasons", F.array_sort(F.array_distinct(F.array_compact(F.array(*out))))).drop("_t", "_c", "_a", "_b", "_keys", "v")


def as_list(name: str, v: str = "v") -> Column:
    """A JSON field as a list of strings: a list without its nulls, another value alone, nothing as an empty list."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    many = F.array_compact(F.try_variant_get(v, f"$.{name}", "array<string>"))
    one = F.try_variant_get(v, f"$.{name}", "string")
    return F.when(F.coalesce(kind, F.lit("VOID")) == "VOID", F.array().cast("array<string>")).when(F.startswith(kind, F.lit("ARRAY")), many).otherwise(F.array(one))


def repaired(df: DataFrame, json: str = "json") -> DataFrame:
    """Adds a risk analysis whose missing or wrong fields have their defaults."""
    df = df.withColumn("v", F.try_parse_json(json))
    text = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    enum = lambda f, allowed, default: F.when(F.lower(text(f)).isin(*allowed), F.lower(text(f))).otherwise(default)
    said = F.lower(F.trim(text("need_human_review")))
    number = text("confidence").try_cast("double")
    return df.withColumns({
        "risk_type": enum("risk_type", RISK_TYPES, "negative_review"), "risk_level": enum("risk_level", RISK_LEVELS, "medium"), "sentiment": enum("sentiment", SENTIMENTS, "neutral"), "evidence": as_list("evidence"),
        "need_human_review": F.when(said.isin("true", "1", "yes"), True).when(said.isin("false", "0", "no"), False).otherwise(True), "confidence": F.when(number.isNotNull(), clamp(number, 0.0, 1.0)).otherwise(0.5), "missing_information": as_list("missing_information"),
    }).drop("v")


def evaluated(done: DataFrame, gold: DataFrame, raw: DataFrame) -> DataFrame:
    """Rates over all gold rows: done as processed() gives it, gold (id, risk_type, risk_level, need_human_review), raw (id,
    output). A final schema is always valid by construction, so no rate says so."""
    pairs = gold.select("id", *(F.col(c).alias(f"g_{c}") for c in ("risk_type", "risk_level", "need_human_review"))).join(done, "id", "left").join(raw, "id", "left")
    right = F.col("eligible")
    for c in ("risk_type", "risk_level", "need_human_review"):
        right = right & (F.col(c) == F.col(f"g_{c}"))
    banned = F.lit(False)
    for w in PROHIBITED:
        banned = banned | F.contains(F.lower("output"), F.lit(w))
    rate = lambda c: F.round(F.count(F.when(c, 1)) / F.greatest(F.count("*"), F.lit(1)), 8)
    fallback = F.col("source") == "operational_safety_fallback"
    return pairs.agg(
        F.count("output").alias("outputs"), rate(F.col("extracted")).alias("extracted_rate"), rate(F.col("eligible")).alias("eligible_rate"), rate(fallback).alias("fallback_rate"), rate(F.trim("output") == "").alias("empty_rate"),
        rate(~F.coalesce("eligible", F.lit(False))).alias("abstention_rate"), rate(right).alias("coverage_adjusted_accuracy"), F.count(F.when(banned, 1)).alias("prohibited_actions"),
        *(F.count(F.when(F.col("source") == x, 1)).alias(f"from_{x}") for x in ("raw_model", "contract_normalization", "operational_safety_fallback")),
    )

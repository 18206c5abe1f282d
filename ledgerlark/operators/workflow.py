"""Order, task and run workflows as set-based changes, and audits over their logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- money and time ----


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; null while one is missing."""
    return F.timestamp_diff("MILLISECOND", start, end)


def paid_in_full(cents: Column, amount: Column) -> Column:
    """Whether a notified number of cents, as text, is the amount to two places; anything but digits isn't."""
    told = F.when(cents.rlike(r"^\d+$"), (cents.cast("decimal(20,0)") / 100).cast("decimal(20,2)"))
    return F.coalesce(told == amount.cast("decimal(20,2)"), F.lit(False))


def refundable(requested: Column, actual: Column, freight: Column) -> Column:
    """Whether a refund stays within what was paid without freight."""
    return F.coalesce(requested <= actual - freight, F.lit(False))


def rule_expired(rule: Column, expires: Column, as_of: Column) -> Column:
    """A missing rule has expired, and one whose time has passed; a rule without a time hasn't."""
    return rule.isNull() | F.coalesce(expires < as_of, F.lit(False))


def day_of(text: Column) -> Column:
    """The day of an ISO time, with or without a zone, or of an ISO day; null for anything else or an empty text."""
    stamp = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).otherwise(stamp)


# ---- tasks, runs and groups ----


def handled(tasks: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tasks (id, analysis_id, status), changes (task_id, new_status, operator, note, feedback) -> tasks with their new
    status, a log row and a feedback row for each change. A change of an unknown task is logged without an old status; a
    missing feedback is an acceptance with the note."""
    both = changes.join(tasks.select(F.col("id").alias("task_id"), "analysis_id", F.col("status").alias("old_status")), "task_id", "left")
    last = changes.groupBy(F.col("task_id").alias("id")).agg(F.max("new_status").alias("new_status"))
    updated = tasks.join(last, "id", "left").select("id", "analysis_id", F.coalesce("new_status", "status").alias("status"))
    log = both.select("task_id", "old_status", "new_status", "operator", "note")
    feedback = both.select("task_id", "analysis_id", F.coalesce("feedback", F.lit("accept")).alias("feedback_type"), "note", "operator")
    return updated, log, feedback


def run_snapshots(runs: DataFrame, steps: DataFrame, delta: dict[str, Column]) -> DataFrame:
    """runs (id, snapshot map) and their steps (run_id, status, role) -> the snapshot with delta and counters put over it,
    later values winning."""
    told = steps.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))  # roles are few
    rows = runs.join(told, "id", "left")
    fresh = {k: v.cast("string") for k, v in delta.items()} | {"stepCount": F.coalesce("n", F.lit(0)).cast("string"), "failedStepCount": F.coalesce("failed", F.lit(0)).cast("string"), "roles": F.coalesce("roles", F.lit(""))}
    put = F.create_map(*(x for k, v in fresh.items() for x in (F.lit(k), v)))
    return rows.select("id", F.map_concat(F.map_filter(F.coalesce("snapshot", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*fresh)), put).alias("snapshot"))


def replayed(runs: DataFrame, analyse: dict[str, Column], next_id: int) -> DataFrame:
    """Clones of runs under new ids with re-analysed fields, and which of these changed."""
    return runs.select(
        (F.col("id") + next_id).alias("id"), F.col("id").alias("replay_of"), F.lit(True).alias("is_replay"), *(v.alias(k) for k, v in analyse.items()),
        F.array_join(F.array_compact(F.array(*(F.when(~v.eqNullSafe(F.col(k)), F.lit(k)) for k, v in analyse.items()))), ",").alias("changed"),
    )


def group_states(members: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """members (group_id, rule_id, user_id), rules (rule_id, size, expires) -> each member with the state of its group: success
    when founder and members fill it, else fail once the rule has expired, else open."""
    groups = members.groupBy("group_id").agg(F.countDistinct("user_id").alias("n"))  # joined back, so a large group is split
    rows = members.join(groups, "group_id").join(rules.withColumn("_known", F.lit(1)), "rule_id", "left")
    state = F.when(F.col("n") >= F.col("size"), "success").when(rule_expired(F.col("_known"), F.col("expires"), as_of), "fail").otherwise("open")
    return rows.select("group_id", "user_id", state.alias("state"))


def breaker_states(events: DataFrame, key: str, ts: str, ok: str, failures: int = 3, window: int = 10, cooldown: int = 30) -> DataFrame:
    """Adds allowed and state (after the event): of each key's requests in time order those that an open breaker refuses.

    It opens on at least `failures` failures among the last `window` outcomes, lets one through `cooldown` seconds later,
    and closes with an empty memory if that one is well. Refused requests have no outcome. A key's rows pass one task in
    order; what it remembers is `window` outcomes.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, seen, state, opened = None, [], "CLOSED", 0
        for b in batches:
            allowed, states = [], []
            for k, at, good in zip(b[key], b["_at"], b[ok], strict=True):
                if k != current:
                    current, seen, state, opened = k, [], "CLOSED", 0
                if state == "OPEN" and at - opened >= cooldown * 1_000_000:
                    state = "HALF_OPEN"
                through = state != "OPEN"
                if through:
                    if good and state == "HALF_OPEN":
                        state, seen = "CLOSED", []
                    seen = [*seen, bool(good)][-window:]
                    if not good and seen.count(False) >= failures:
                        state, opened = "OPEN", at
                allowed.append(through)
                states.append(state)
            yield b.drop(columns=["_at"]).assign(allowed=allowed, state=states)

    dealt = events.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "_at", "id")
    return dealt.mapInPandas(step, events.schema.add("allowed", "boolean").add("state", "string"))


def isolated(rows: DataFrame, result: Column, required: list[str]) -> tuple[DataFrame, Column]:
    """rows with result, status and error: an item whose result can't be made, or that lacks a required field, fails alone.
    Also the columns that count a batch."""
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
    out = rows.withColumns({"result": result, "_lacking": lacking})
    error = F.when(F.size("_lacking") > 0, F.concat(F.lit("missing "), F.array_join("_lacking", ","))).when(F.col("result").isNull(), "not analysable")
    out = out.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failed")).drop("_lacking")
    return out, F.struct(F.count("*").alias("total"), F.count(F.when(F.col("status") == "success", 1)).alias("success"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))


# ---- audits ----

VULNERABILITIES = "struct<Results: array<struct<Target: string, Vulnerabilities: array<struct<VulnerabilityID: string, Severity: string>>>>>"


def findings(reports: DataFrame, severities: tuple[str, ...], json: str = "report") -> DataFrame:
    """(id, JSON scan report) -> a row for each vulnerability of a wanted severity; a report without any gives none."""
    results = reports.select("id", F.explode(F.from_json(json, VULNERABILITIES)["Results"]).alias("r"))
    found = results.select("id", F.col("r.Target").alias("target"), F.explode("r.Vulnerabilities").alias("v"))
    return found.select("id", "target", F.col("v.VulnerabilityID").alias("vulnerability"), F.upper(F.coalesce("v.Severity", F.lit(""))).alias("severity")).where(F.col("severity").isin(*severities))


def checksums(files: DataFrame) -> DataFrame:
    """(path, content) -> path, size and SHA-256; a missing content is an empty one."""
    content = F.coalesce("content", F.lit(b""))
    return files.select("path", F.octet_length(content).cast("bigint").alias("size"), F.sha2(content, 256).alias("sha256"))


def _holding(word: str) -> Callable[[Column], Column]:
    return lambda name: F.contains(F.lower(name), F.lit(word))


def soak_report(events: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """(ts, kind, ok, latency, attributes as JSON) -> one row: seconds, requests, success rate, kinds, latency percentiles and
    the number of events whose attributes have a forbidden name."""
    leak = F.lit(False)
    names = F.coalesce(F.json_object_keys("attributes"), F.array().cast("array<string>"))
    for word in forbidden:
        leak = leak | F.exists(names, _holding(word))
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency)").cast("bigint")
    return events.agg(
        F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("seconds"), F.count("*").alias("requests"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"), F.countDistinct("kind").alias("kinds"),
        rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.count(F.when(leak, 1)).alias("leaks"),
    )


# ---- names, prompts and plans ----


def agent_role(step: Column, tool: Column) -> tuple[Column, Column]:
    """Role and goal of a step by the first word that its or its tool's name holds."""
    value = F.lower(F.concat_ws(" ", F.coalesce(step, F.lit("null")), F.coalesce(tool, F.lit("null"))))
    any_of = lambda *words: F.lit(False) if not words else F.contains(value, F.lit(words[0])) | any_of(*words[1:])
    cases, risk, advice = any_of("case", "retrieve"), any_of("risk", "conflict", "audit"), any_of("operation", "suggestion", "advisor")
    pick = lambda a, b, c, d: F.when(cases, a).when(risk, b).when(advice, c).otherwise(d)
    role = pick("Case Retriever Agent", "Risk Auditor Agent", "Operation Advisor Agent", "Review Analyst Agent")
    goal = pick(
        "Retrieve similar historical cases and evidence snippets.", "Judge risk types, risk level, modality conflict, and review priority.", "Generate customer-service, after-sales, and product operation suggestions.",
        "Analyze review text, rating, image signals, and sentiment.",
    )
    return role, goal


def rendered(parts: list[tuple[str, Column]]) -> Column:
    """Named lines of a prompt; a missing or blank part has none."""
    return F.concat_ws("\n", *(F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) != "", F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in parts))


def bigram_tokens(text: Column) -> Column:
    """The set of words of two or more characters and of pairs of neighbouring characters without a space, lower-cased."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.regexp_replace(F.lower(t), r"[^a-z0-9\x{4e00}-\x{9fa5}]+", " "), r"\s+"), lambda w: F.length(w) >= 2)
    chars = F.array_remove(F.split(t, ""), "")
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))
    each = F.transform(F.array_distinct(pairs), lambda p: F.lower(F.trim(p)))  # a text has few different pairs
    return F.array_distinct(F.concat(words, F.filter(each, lambda p: F.length(p) == 2)))


def with_query_plan(df: DataFrame, injected: Column, text: str = "text") -> DataFrame:
    """Adds intent, entities (at most 8), keywords (at most 12) and up to three rewrites of a query. A query that holds an
    injection is blocked and has only itself."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    df = df.withColumns({"_t": t, "blocked": injected})
    low = F.lower("_t")
    after = F.contains(low, F.lit("refund")) | F.contains(low, F.lit("return")) | F.col("_t").rlike("退货|退款|售后")
    none = F.array().cast("array<string>")
    df = df.withColumns({
        "intent": F.when(F.col("blocked"), "blocked").when(after, "after_sales").otherwise("review_risk"),
        "entities": F.when(F.col("blocked"), none).otherwise(F.slice(F.regexp_extract_all("_t", F.lit(r"[A-Z]{2,}-?\d+|[\x{4e00}-\x{9fff}]{2,}"), F.lit(0)), 1, 8)),
        "keywords": F.when(F.col("blocked"), none).otherwise(F.transform(F.slice(F.regexp_extract_all("_t", F.lit(r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]+"), F.lit(0)), 1, 12), lambda w: F.lower(w))),
    })
    lexical, semantic = F.array_join(F.slice("keywords", 1, 8), " "), F.trim(F.concat_ws(" ", "intent", F.array_join(F.slice("entities", 1, 4), " ")))
    more = F.array_distinct(F.array_compact(F.array(F.col("_t"), F.when(~F.col("blocked"), F.nullif(lexical, F.lit(""))), F.when(~F.col("blocked"), semantic))))
    return df.withColumn("rewrites", F.slice(more, 1, 3)).drop("_t")


#: Nodes of a governed step plan; those in the second list don't run for a blocked input, those in the third call tools.
NODES = ("input_guard", "intent_router", "query_planner", "retrieve", "rerank", "verify_evidence", "decide", "policy_guard", "human_review_router", "response_assembler", "audit_sink")
SKIPPED, TOOLS = ("retrieve", "verify_evidence", "decide"), {"retrieve": "search_cases", "verify_evidence": "verify_evidence"}


def step_plan(df: DataFrame, blocked: Column, most_steps: int, most_calls: int) -> DataFrame:
    """A row for each step of each request: its place, node, tool and status. Three steps over the limit are allowed, tool
    calls only up to theirs."""
    calls, each = 0, []
    for i, node in enumerate(NODES[: most_steps + 3]):
        status = F.when(blocked, "SKIPPED_INPUT_BLOCKED") if node in SKIPPED else F.when(F.lit(False), "")
        if node in TOOLS:
            status = status.when(F.lit(calls >= most_calls), "SKIPPED_MAX_TOOL_CALLS")
            calls += 1
        each.append(F.struct(F.lit(i).alias("place"), F.lit(node).alias("node"), F.lit(TOOLS.get(node)).cast("string").alias("tool"), status.otherwise("RUN").alias("status")))
    return df.select(*df.columns, F.explode(F.array(*each)).alias("_s")).select(*df.columns, "_s.*")


#: What an authorisation must name.
AUTHORIZED_FIELDS = (
    "source.source_id", "source.data_owner", "source.authorization_basis", "authorization.authorized_by", "authorization.authorized_at", "authorization.authorization_document_reference", "approval.project_approval_status",
)


def path_text(v: str, dotted: str) -> Column:
    """The value under a dotted path of a variant as text; null where a part is missing."""
    return F.try_variant_get(v, f"$.{dotted}", "string")


def authorized(df: DataFrame, manifest: str, use: Column, kind: Column, today: Column) -> DataFrame:
    """Adds decision, reason and missing fields of a JSON manifest for an intended use and kind of data; the first rule that
    fits decides."""
    df = df.withColumn("v", F.try_parse_json(manifest))
    df = df.withColumn("missing", F.array_compact(F.array(*(F.when(F.coalesce(path_text("v", f), F.lit("")) == "", F.lit(f)) for f in AUTHORIZED_FIELDS))))
    told = lambda group, name: F.coalesce(F.element_at(F.try_variant_get("v", f"$.{group}", "map<string,boolean>"), name), F.lit(False))
    approved = F.coalesce(F.try_variant_get("v", "$.approval.approved_by_project_owner", "boolean"), F.lit(False)) & (path_text("v", "approval.project_approval_status") == "approved")
    expired = F.coalesce(day_of(path_text("v", "authorization.authorization_expiry")) < today, F.lit(False))
    rules = [
        (F.col("v").isNull(), "incomplete", F.lit("authorization_manifest_missing")), (F.size("missing") > 0, "incomplete", F.lit("required_authorization_fields_missing")), (~approved, "blocked", F.lit("project_owner_approval_missing")),
        (expired, "expired", F.lit("authorization_expired")), (~told("allowed_uses", use), "blocked", F.concat(F.lit("allowed_uses."), use, F.lit("_false"))), (~told("data_scope", kind), "blocked", F.concat(F.lit("data_scope."), kind, F.lit("_false"))),
    ]
    decision, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, d, r in rules:
        decision, reason = decision.when(test, d), reason.when(test, r)
    return df.withColumns({"decision": decision.otherwise("allowed"), "reason": reason.otherwise("authorization_allowed")}).drop("v")


def root_causes(report: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """A row for each rule (cause, test, advice) that a row of figures meets, in the order of the rules."""
    each = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(i).alias("place"), F.lit(cause).alias("cause"), F.lit(advice).alias("advice"))) for i, (cause, test, advice) in enumerate(rules)]
    return report.select(*report.columns, F.explode(F.array_compact(F.array(*each))).alias("_c")).select(*report.columns, "_c.*")


def guarded(rows: DataFrame, split: str, text: str, known: tuple[str, ...], held_out: tuple[str, ...], sealed: DataFrame) -> DataFrame:
    """Rows with refusal: HOLDOUT, UNKNOWN_SPLIT or SEALED_HASH for those that may not be read, null for the others. sealed
    (sha256) is joined, not collected."""
    marked = rows.withColumn("_h", F.sha2(F.coalesce(text, F.lit("")), 256)).join(sealed.select(F.col("sha256").alias("_h"), F.lit(True).alias("_sealed")).distinct(), "_h", "left")
    refusal = F.when(F.col(split).isin(*held_out), "HOLDOUT").when(~F.coalesce(F.col(split).isin(*known), F.lit(False)), "UNKNOWN_SPLIT").when(F.col("_sealed"), "SEALED_HASH")
    return marked.withColumn("refusal", refusal).drop("_h", "_sealed")


def permissions(grants: DataFrame, users: DataFrame) -> DataFrame:
    """users (user_id, roles array), grants (role, permission) -> each user's permissions, sorted, and whether one is '*'. No
    role, or none with a grant, is an empty set."""
    listed = users.select("user_id", F.explode_outer("roles").alias("role")).join(grants, "role", "left")
    held = listed.groupBy("user_id").agg(F.array_sort(F.array_compact(F.collect_set("permission"))).alias("permissions"))  # permissions are few
    return held.select("user_id", F.array_join("permissions", ",").alias("permissions"), F.array_contains("permissions", "*").alias("everything"))


def inserted(rows: DataFrame, target: dict[str, str], defaults: dict[str, Column]) -> DataFrame:
    """Rows in the form of a target table: what is null or missing has its column's default, or stays null."""
    there = set(rows.columns)
    value = lambda c, t: F.col(c).cast(t) if c in there else F.lit(None).cast(t)
    return rows.select(*(F.coalesce(value(c, t), defaults[c].cast(t)).alias(c) if c in defaults else value(c, t).alias(c) for c, t in target.items()))

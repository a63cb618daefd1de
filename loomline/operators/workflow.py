"""Mining recurring workflow guidance from sessions: rules, evidence, clusters, decisions, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.identity import canonical_key
from loomline.functions.prompts import cleaned_statement, statement_flags
from loomline.functions.text import let, matches, matches_any, rule, squeezed, trimmed
from loomline.sources.scratch import spread, stored

# Fixed values: (rule, cluster, kind of evidence, pattern).
VERIFY = "(verify|verification|test|cibuild|ci|proof|passes|green)"
CHECK = "(verify|verification|test|cibuild|ci|proof)"
MARKERS = [
    ("validation-explicit-verify", "validation", "explicit_preference", rf"\b(?:always|must)\b[^.?!]*{VERIFY}|\bnever\b[^.?!]*(skip|ship|claim|finish|merge|complete)[^.?!]*(without\s+)?{CHECK}"),
    ("validation-explicit-verify", "validation", "contradiction", rf"\b(?:without|no need|never need|never have to|do not need|don't need)\b[^.?!]*{CHECK}|\bskip\b[^.?!]*{CHECK}"),
    ("validation-scope-correction", "validation", "correction", r"\b(not what i asked|didn'?t ask|wrong task|stop doing|stop)\b"),
    ("review-independent-closeout", "review", "accepted_pattern", r"\b(review|reviewer|approve|reject|self-review|qa)\b"),
    ("shipping-concrete-evidence", "shipping", "accepted_pattern", r"\b(pr|pull request|push|commit|ci|branch|merge|ship|shipping)\b"),
    ("debugging-root-cause-evidence", "debugging", "accepted_pattern", r"\b(debug|root cause|failure|failing|regression|logs?|trace)\b"),
    ("capture-durable-guidance", "capture", "accepted_pattern", r"\b(create|write|update|encode|capture|mine|extract|generate)\b[^.?!]*(skill|rule|workflow|preference|memory)|\b(skill|rule|workflow)\b[^.?!]*(guidance|preference|artifact|doc)"),
    ("delegation-quality-speed-check", "delegation", "accepted_pattern", r"\b(subagent|delegate|parallel|reviewer|agent)\b"),
    ("communication-evidence-first", "communication", "explicit_preference", r"\b(concise|terse|brief|evidence|summary|final)\b"),
    ("simplification-smallest-maintainable", "simplification", "accepted_pattern", r"\b(simple|simplify|smallest|refactor|abstraction|over-?engineer)\b"),
]
# What each rule becomes (kind of artifact, guidance, trigger).
GUIDANCE = {
    "validation-explicit-verify": ("rule", "Run the relevant verification before claiming behavior works or work is complete.", "Before claiming completion, merge readiness, or CI status."),
    "validation-scope-correction": ("rule", "Treat user corrections like “not what I asked” as scope failures and realign before continuing.", "When user feedback indicates the agent solved a different problem or kept going in the wrong direction."),
    "review-independent-closeout": ("skill", "Use an independent review or explicit self-review path before closing review-gated work.", "When work enters a review-gated task, PR, or td issue closeout."),
    "shipping-concrete-evidence": ("workflow_doc", "Keep shipping evidence tied to concrete commands, commits, PRs, and CI state rather than local claims.", "When preparing a change for review, push, PR, or merge."),
    "debugging-root-cause-evidence": ("skill", "Debug from root cause and preserve the failing evidence before changing implementation.", "When tests, builds, runtime commands, or user reports expose a failure."),
    "capture-durable-guidance": ("rule", "Capture durable workflow corrections as skills, rules, docs, or reviewable candidates instead of leaving them only in chat.", "When a session contains reusable agent-behavior guidance."),
    "delegation-quality-speed-check": ("workflow_doc", "Delegate only when it improves speed, quality, or independent verification; keep deterministic small edits inline.", "When a task can be split across independent research, review, or implementation lanes."),
    "communication-evidence-first": ("rule", "Keep user-facing updates concise, evidence-first, and focused on decisions, checks, and residual risk.", "When reporting progress, review findings, plans, or final status."),
    "simplification-smallest-maintainable": ("rule", "Prefer the smallest maintainable change and avoid adding abstractions before the existing pattern requires them.", "When choosing between a direct fix and a broader abstraction."),
}
GENERIC = [
    r"at every handoff and turn end",
    r"branch/worktree no agent-owned dirt before handoff",
    r"do not call a persistent REPL in parallel",
    r"prefer skills and repo evidence over broad prose recall",
    r"stop when request fulfilled",
    r"when `?qa`? CLI on PATH",
]
SHORTEST_EXCERPT, LONGEST_EXCERPT = 20, 200
TIERS = {"instinct": 2, "keyword": 1}
CONTRADICTED, STRONG_SESSIONS, OVERLAP = 0.2, 3, 0.6
RANK = {"strong": 4, "medium": 3, "weak": 2, "contradicted": 1}
ADVICE = {"strong": "adopt", "medium": "consider", "contradicted": "ask", "weak": "dismiss"}
LOCAL_PATH = r"\b(?:[A-Za-z]:)?/?(?:Users|home)/[^\s]+"
SECRET = r"(?i)\b[A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|API_KEY)\b\s*[=:]\s*\S+"


def redacted(c: Column) -> Column:
    """A text without home paths and values of secrets."""
    return F.regexp_replace(F.regexp_replace(c, LOCAL_PATH, "[local-path]"), SECRET, "[secret-ref]")


def seeds(sessions: DataFrame, text: str = "text") -> DataFrame:
    """session_id, rule_id, cluster, kind of every marker that a session's text has."""
    t = redacted(F.col(text))

    def hit(rule_id: str, cluster: str, kind: str, pattern: str) -> Column:
        artifact, guidance, trigger = GUIDANCE[rule_id]
        fields = {"rule_id": rule_id, "cluster": cluster, "kind": kind, "source_tier": "keyword", "artifact_kind": artifact, "guidance": guidance, "trigger": trigger}
        return F.when(matches(t, pattern), F.struct(*(F.lit(v).alias(n) for n, v in fields.items()), F.lit(None).cast("string").alias("level")))

    hits = [hit(*m) for m in MARKERS]
    return sessions.select("session_id", F.explode(F.array_compact(F.array(*hits))).alias("s")).select("session_id", "s.*")


def record_seeds(records: DataFrame, observations: DataFrame) -> DataFrame:
    """Seeds of general workflow records that are established or proven: every observation is evidence.

    ``records``: instinct_id, scope, domain, maturity, trigger, finding. ``observations``: instinct_id,
    session_id, reinforcing.
    """
    own = records.where("scope = 'global' and domain = 'workflow' and maturity in ('established', 'proven')")
    named = own.select(
        "instinct_id", F.concat(F.lit("instinct-"), canonical_key(F.col("trigger"), F.col("finding"))).alias("rule_id"), F.lit("capture").alias("cluster"), F.lit("instinct").alias("source_tier"),
        F.lit("skill").alias("artifact_kind"), F.col("finding").alias("guidance"), "trigger", F.when(F.col("maturity") == "proven", "strong").otherwise("medium").alias("level"),
    )
    kind = F.when(F.col("reinforcing"), "accepted_pattern").otherwise("contradiction")
    return observations.select("instinct_id", "session_id", kind.alias("kind")).join(named, "instinct_id").select("session_id", "rule_id", "cluster", "kind", "source_tier", "artifact_kind", "guidance", "trigger", "level")


def in_window(sessions: DataFrame, days: int, now: Column, source: str | None = None, updated_at: str = "updated_at") -> DataFrame:
    """Sessions updated in the last ``days`` before ``now``, of a tool if one is given; times that are none are left out."""
    at = F.try_to_timestamp(F.col(updated_at).cast("string"))
    out = sessions.where(F.coalesce(at >= now - F.make_dt_interval(days=F.lit(days)), F.lit(False)))
    return out if source is None else out.where(F.col("source_tool") == source)


def sentence(text: Column, pattern: str) -> Column:
    """The sentence or line of the first match of a pattern; null without one."""

    def around(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(rule(pattern)))
        head = F.regexp_extract(F.substring(t, F.lit(1), at - 1), r"[^.!?\n]*\z", 0)
        return F.when(at > 0, trimmed(F.concat(head, F.regexp_extract(F.substring(t, at, F.length(t)), r"\A[^.?!\n]*[.?!\n]?", 0))))

    return let(text, around)


def excerpt(parts: Column, pattern: str, clean: Column | None = None) -> Column:
    """The first useful sentence with a match in an array of texts, or else in all of them joined; empty if there is none.

    ``clean``: ``parts`` redacted, where they are at hand. Only texts with a match are tidied, in order until one is useful.
    """

    def useful(t: Column) -> Column:
        return (F.length(t) >= SHORTEST_EXCERPT) & ~matches_any(t, GENERIC)

    def said(t: Column) -> Column:
        return let(cleaned_statement(redacted(sentence(t, pattern))), lambda x: F.when(useful(x), x))

    hits = F.filter(F.transform(parts, redacted) if clean is None else clean, lambda t: matches(t, pattern))
    in_one = F.aggregate(hits, F.lit(None).cast("string"), lambda found, t: F.when(found.isNotNull(), found).otherwise(said(t)))
    first = F.coalesce(in_one, let(redacted(F.array_join(parts, " ")), said))

    def cut(t: Column) -> Column:
        return F.when(F.length(t) <= LONGEST_EXCERPT, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, LONGEST_EXCERPT - 1)), F.lit("…")))

    return F.coalesce(let(first, cut), F.lit(""))


def candidates(found: DataFrame) -> DataFrame:
    """Per rule: sessions with evidence, supporting and contradicting ones, confidence, recommendation, risk and guidance.

    A session that contradicts does not support. More than a fifth of contradicting sessions make
    a contradicted candidate. Records bring their own confidence.
    """
    what = [F.max(n).alias(n) for n in ("source_tier", "artifact_kind", "guidance", "trigger", "level")]
    sides = found.groupBy("cluster", "rule_id", "session_id").agg(
        F.bool_or(F.col("kind") == "contradiction").alias("against"), F.bool_or(F.col("kind").isin("correction", "explicit_preference")).alias("said"), *what
    )
    sums = sides.groupBy("cluster", "rule_id").agg(
        F.count("*").alias("evidence_count"), F.count_if("against").alias("contradicting_count"), F.count_if(~F.col("against")).alias("supporting_count"), F.bool_or("said").alias("said"), *what
    )
    share = F.col("contradicting_count") / F.greatest(F.lit(1), F.col("evidence_count"))
    level = (
        F.when(F.col("level").isNotNull(), F.col("level"))
        .when(share > CONTRADICTED, "contradicted")
        .when(F.col("said") | (F.col("evidence_count") >= STRONG_SESSIONS), "strong")
        .when(F.col("evidence_count") >= 2, "medium")
        .otherwise("weak")
    )
    advice = F.element_at(F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv]), F.col("confidence"))
    zero = F.decode(F.lit(b"\x00"), "UTF-8")
    own = F.concat(F.lit("instinct"), zero, F.regexp_replace("rule_id", r"\Ainstinct-", ""))
    name = F.when(F.col("source_tier") == "instinct", own).otherwise(F.concat("cluster", zero, "rule_id"))
    digest = F.substring(F.sha2(name.cast("binary"), 256), 1, 10)
    out = sums.withColumn("confidence", level).drop("said", "level").withColumns({"recommendation": advice, "candidate_id": F.concat(F.lit("wf_"), digest)})
    risk = F.when(F.col("confidence") == "contradicted", "high").when(F.col("confidence") == "weak", "medium").otherwise("low")
    return out.withColumns({"risk": risk, "artifact_kind": F.when(F.col("recommendation") == "dismiss", "none").otherwise(F.col("artifact_kind"))})


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("confidence"))
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.col("source_tier"))
    return rows.orderBy(F.desc(rank), F.desc(tier), F.desc("evidence_count"), "guidance").limit(limit)


def evidence(found: DataFrame, sessions: DataFrame, cap: int = 10) -> DataFrame:
    """The first ``cap`` sessions of evidence of each rule: those with a useful excerpt, then the newest."""
    cases = F.when(F.lit(False), F.lit(""))
    for rule_id in GUIDANCE:
        own = [F.nullif(excerpt(F.col("_parts"), p, F.col("_clean")), F.lit("")) for r, _, _, p in MARKERS if r == rule_id]
        cases = cases.when(F.col("rule_id") == rule_id, F.coalesce(*own, F.lit("")))
    # Lines are redacted once for all rules of a session, and rules meet them in it without a shuffle of texts for each.
    parts = sessions.select("session_id", "updated_at", F.split("text", "\n").alias("_parts")).withColumn("_clean", F.transform("_parts", redacted))
    rules = found.groupBy("session_id").agg(F.collect_set("rule_id").alias("_rules"))
    met = spread(stored(parts.join(rules, "session_id"), "parts")).select("session_id", "updated_at", "_parts", "_clean", F.explode("_rules").alias("rule_id"))
    rows = met.select("rule_id", "session_id", "updated_at", F.coalesce(cases, F.lit("")).alias("excerpt"))
    first = Window.partitionBy("rule_id").orderBy(F.when(F.col("excerpt") != "", 0).otherwise(1), F.desc("updated_at"), "session_id")
    return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= cap)


def drafts(rows: DataFrame, shown: DataFrame, target: str) -> DataFrame:
    """``rows`` with flags (why guidance is not fit) and markdown: a draft of each fit candidate for ``target``.

    ``shown``: rule_id, session_id, place, excerpt of ``evidence``.
    """

    def tidy(c: Column) -> Column:
        return squeezed(cleaned_statement(c))

    line = F.concat(F.lit("- "), "session_id", F.lit(" ("), "rule_id", F.lit("): "), tidy(F.col("excerpt")))
    lists = shown.groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x.l), "\n").alias("_lines"))
    head = [F.concat(F.lit(f"- {n}: "), F.col(c)) for n, c in (("Candidate", "candidate_id"), ("Rule", "rule_id"), ("Cluster", "cluster"), ("Confidence", "confidence"), ("Recommendation", "recommendation"), ("Risk", "risk"))]
    counts = F.format_string("Supporting: %d; contradicting: %d; total: %d", "supporting_count", "contradicting_count", "evidence_count")
    parts = [
        F.concat(F.lit(f"# Workflow {target} draft: "), "candidate_id"), F.array_join(F.array(*head), "\n"), F.lit("## Trigger"), tidy(F.col("trigger")),
        F.lit("## Guidance"), tidy(F.col("guidance")), F.lit("## Evidence"), counts, F.coalesce("_lines", F.lit("")),
    ]
    flagged = rows.join(lists, "rule_id", "left").withColumn("flags", statement_flags(F.col("guidance")))
    return flagged.withColumn("markdown", F.when(F.size("flags") == 0, F.concat(F.array_join(F.array(*parts), "\n\n"), F.lit("\n")))).drop("_lines")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("candidate_id").agg(F.max_by(F.struct("decision", "note", "decided_at"), "ord").alias("d")).select("candidate_id", "d.*")


def undecided(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    return rows.join(latest_decisions(decisions).select("candidate_id"), "candidate_id", "left_anti")


def already_encoded(rows: DataFrame, known: DataFrame, row_id: str, tokens: str) -> DataFrame:
    """For each row the first known record that has at least 60 % of its tokens.

    Both sides have arrays of distinct tokens; ``known`` has known_id and ord. A record with 60 % of
    a row's tokens lacks at most the other 40 %, so it has one of the row's rarest tokens, one more
    than that: rows meet records on these alone, and common tokens gather no bucket. Full arrays
    then decide. Of the records only the tokens that some row has are kept, and found once.
    """
    used = rows.select(F.explode(tokens).alias("token")).distinct()
    held = stored(known.select("known_id", "ord", F.explode(tokens).alias("token")).join(used, "token", "left_semi"), "held")
    often = held.groupBy("token").agg(F.count("*").alias("n"))
    asked = rows.where(F.size(tokens) > 0).select(row_id, F.explode(tokens).alias("token")).join(often, "token", "left")
    ranked = asked.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("all"))
    size = F.size("all")
    rarest = ranked.select(row_id, F.explode(F.slice("all", F.lit(1), size - F.ceil(size * OVERLAP).cast("int") + 1)).alias("t")).select(row_id, "t.token").where("t.n > 0")
    pairs = rarest.join(held, "token").select(row_id, "known_id").distinct()
    theirs = held.groupBy("known_id", "ord").agg(F.collect_list("token").alias("_b"))
    both = pairs.join(rows.select(row_id, F.col(tokens).alias("_a")), row_id).join(theirs, "known_id")
    enough = both.where(F.size(F.array_intersect("_a", "_b")) >= OVERLAP * F.size("_a"))
    return enough.groupBy(row_id).agg(F.min_by("known_id", "ord").alias("encoded_in"))

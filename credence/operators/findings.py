"""Operators on findings: suppression, gates, scopes, filters, paging, remapping and rollups.

A findings frame has rule_id, message, severity, kind, path, line_start, qualname, fingerprint, properties
(map), suppression_state and suppression_reason; stores are frames keyed by fingerprint.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.identity import ancestors, canonical_qualname, glob_pattern
from credence.functions.lattice import SEVERITIES, severity_rank

#: Rule ids that mean files, or parts of them, were not analysed.
UNANALYZED = ("WLN-ENGINE-PARSE-ERROR", "WLN-ENGINE-FILE-SKIPPED", "WLN-ENGINE-SOURCE-ROOT-MISSING", "WLN-ENGINE-FILE-FAILED")
INCOMPLETE = (*UNANALYZED, "WLN-ENGINE-FUNCTION-SKIPPED", "WLN-ENGINE-PYDANTIC-DISCOVERY-LIMIT")
LINELESS = "WLN-ENGINE-LINELESS-DEFECT"
ENGINE_PATH = "<engine>"
#: Closed vocabularies of the filter lens, and the property keys that count as a tier.
VOCABULARY = {"severity": ("CRITICAL", "ERROR", "WARN", "INFO", "NONE"), "suppression": ("active", "baselined", "waived", "judged"), "kind": ("defect", "fact", "metric", "classification", "suggestion")}
TIER_KEYS = ("tier", "declared_tier", "actual_tier", "declared_return", "actual_return", "arg_taint")


def replace_lineless(findings: DataFrame) -> DataFrame:
    """A defect without a line, outside the engine's own path, becomes an engine defect as severe."""
    hit = (F.col("kind") == "defect") & (F.col("path") != ENGINE_PATH) & F.col("line_start").isNull()
    digest = F.sha2(F.concat_ws("\0", F.lit(LINELESS), "rule_id", "path", "fingerprint", "kind"), 256)
    kept = F.create_map(*[x for k, c in (("original_rule_id", "rule_id"), ("original_path", "path"), ("original_fingerprint", "fingerprint"), ("original_kind", "kind")) for x in (F.lit(k), F.col(c))])
    return findings.withColumns(
        {"fingerprint": F.when(hit, digest).otherwise(F.col("fingerprint")), "properties": F.when(hit, kept).otherwise(F.col("properties")), "rule_id": F.when(hit, LINELESS).otherwise(F.col("rule_id")), "path": F.when(hit, ENGINE_PATH).otherwise(F.col("path"))}
    )


def suppress(findings: DataFrame, baseline: DataFrame, waivers: DataFrame, judged: DataFrame, today: Column) -> DataFrame:
    """Annotate defects: an active waiver, else a judgement, else the baseline.  ``today`` is a value
    of the caller's, never the clock."""
    w = waivers.filter(F.col("expires").isNull() | (F.col("expires") >= today)).groupBy("fingerprint").agg(F.min("reason").alias("__waived"), F.lit(True).alias("__w"))
    j = judged.groupBy("fingerprint").agg(F.min("rationale").alias("__judged"), F.lit(True).alias("__j"))
    b = baseline.select("fingerprint", F.lit(True).alias("__b")).distinct()
    out = findings.join(w, "fingerprint", "left").join(j, "fingerprint", "left").join(b, "fingerprint", "left")
    own = (F.col("kind") == "defect") & (F.col("rule_id") != LINELESS)
    state = F.when(own & F.col("__w"), "waived").when(own & F.col("__j"), "judged").when(own & F.col("__b"), "baselined").otherwise(F.col("suppression_state"))
    reason = F.when(own & F.col("__w"), F.col("__waived")).when(own & F.col("__j"), F.col("__judged")).otherwise(F.col("suppression_reason"))
    return out.withColumn("suppression_reason", reason).withColumn("suppression_state", state).select(*findings.columns)


def delta_relabel(findings: DataFrame, changed: DataFrame, affected: DataFrame, since: str) -> DataFrame:
    """Active defects outside the changed files (path) and the affected closure (qualname) become
    baselined; findings about incomplete analysis stay."""
    delta_path = F.when(F.col("rule_id") == LINELESS, F.col("properties")["original_path"]).otherwise(F.col("path"))
    c = changed.select(F.col("path").alias("__path"), F.lit(True).alias("__c")).distinct()
    a = affected.select(F.col("qualname").alias("__qual"), F.lit(True).alias("__a")).distinct()
    out = findings.withColumn("__dp", delta_path).join(c, F.col("__dp") == F.col("__path"), "left").join(a, F.col("qualname") == F.col("__qual"), "left")
    old = (F.col("kind") == "defect") & (F.col("suppression_state") == "active") & ~F.col("rule_id").isin(*INCOMPLETE) & F.col("__c").isNull() & F.col("__a").isNull()
    old = old & ~((F.col("rule_id") == LINELESS) & F.col("__dp").isNull())
    return out.withColumn("suppression_reason", F.when(old, f"delta: unchanged since {since}").otherwise(F.col("suppression_reason"))).withColumn("suppression_state", F.when(old, "baselined").otherwise(F.col("suppression_state"))).select(*findings.columns)


def display_filter(findings: DataFrame, affected: DataFrame, files: DataFrame) -> DataFrame:
    """Findings on affected entities, or below affected classes; those without a name by their file.
    Names are tried with all their dotted prefixes, so it stays an equi-join."""
    f = findings.withColumn("__id", F.monotonically_increasing_id())
    tried = f.filter("qualname IS NOT NULL").select("*", F.explode(ancestors(canonical_qualname(F.col("qualname")))).alias("__a"))
    named = tried.join(affected.select(F.col("qualname").alias("__q")).distinct(), F.col("__a") == F.col("__q"), "left_semi").dropDuplicates(["__id"])
    other = f.filter("qualname IS NULL").join(files.select(F.col("path").alias("__p")).distinct(), F.col("path") == F.col("__p"), "left_semi")
    return named.select(*findings.columns).unionByName(other.select(*findings.columns))


def where(findings: DataFrame, lens: Mapping[str, str]) -> DataFrame:
    """Conjunction of rule_id, qualname, severity, suppression, kind, path_glob, sink and tier."""
    lens = {k: v for k, v in lens.items() if v is not None}
    allowed = {"rule_id", "qualname", "severity", "suppression", "kind", "path_glob", "sink", "tier"}
    if unknown := set(lens) - allowed:
        raise ValueError(f"unknown filter keys {sorted(unknown)}; allowed: {sorted(allowed)}")
    for key, value in lens.items():
        if key in VOCABULARY:
            match = [v for v in VOCABULARY[key] if v.lower() == str(value).lower()]
            if not match:
                raise ValueError(f"unknown {key} {value!r}; allowed: {VOCABULARY[key]}")
            value = match[0]
        column = {"suppression": "suppression_state"}.get(key, key)
        if key == "path_glob":
            findings = findings.filter(F.col("path").rlike(glob_pattern(value)))
        elif key == "sink":
            findings = findings.filter(F.col("properties")["sink"] == value)
        elif key == "tier":
            findings = findings.filter(F.greatest(*[F.coalesce(F.col("properties")[k] == value, F.lit(False)) for k in TIER_KEYS]))
        else:
            findings = findings.filter(F.col(column) == value)
    return findings


def display_order() -> list[Column]:
    """Severity from the worst down, then path, line, rule and fingerprint."""
    worst = F.coalesce(F.lit(len(SEVERITIES) - 1) - severity_rank(F.col("severity")), F.lit(99))
    return [worst, F.col("path"), F.coalesce("line_start", F.lit(0)), F.col("rule_id"), F.col("fingerprint")]


def page(findings: DataFrame, offset: int, limit: int) -> DataFrame:
    return findings.orderBy(*display_order()).offset(offset).limit(limit)


def triage(findings: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first active defects in scan order."""
    return findings.filter((F.col("kind") == "defect") & (F.col("suppression_state") == "active")).orderBy(*order).limit(limit)


def scan_summary(findings: DataFrame) -> DataFrame:
    defect = F.col("kind") == "defect"
    count = lambda c: F.count_if(c)
    states = {"active": "active", "baselined": "baselined", "waived": "waived", "judged": "judged"}
    return findings.agg(
        F.count(F.lit(1)).alias("total"), *[count(defect & (F.col("suppression_state") == v)).alias(k) for k, v in states.items()], count(~defect).alias("informational"), count(F.col("rule_id").isin(*UNANALYZED)).alias("unanalyzed")
    )


def gate_breakdown(findings: DataFrame, fail_on: str) -> DataFrame:
    hit = (F.col("kind") == "defect") & (severity_rank(F.col("severity")) >= SEVERITIES.index(fail_on))
    live = F.col("suppression_state") == "active"
    return findings.agg(F.count_if(hit & live).alias("active"), F.count_if(hit & ~live).alias("suppressed"))


def would_trip_at(findings: DataFrame) -> DataFrame:
    live = findings.filter((F.col("kind") == "defect") & (F.col("suppression_state") == "active"))
    return live.agg(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(severity_rank(F.col("severity"))) + 1).alias("would_trip_at"))


def gate_decision(gate: DataFrame, files_scanned: int, fail_on: str | None, fail_on_unanalyzed: bool = False, fail_on_inert: bool = False, posture: DataFrame | None = None, advisory: bool = False) -> DataFrame:
    """One row: verdict NOT_EVALUATED, PASSED or FAILED, and what tripped.  ``gate`` is the population
    that gates, which need not be the displayed one."""
    live = (F.col("kind") == "defect") & (F.col("suppression_state") == "active")
    threshold = SEVERITIES.index(fail_on) if fail_on else 99
    row = gate.agg(
        F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(F.when(live, severity_rank(F.col("severity")))) + 1).alias("would_trip_at"),
        F.coalesce(F.max(live & (severity_rank(F.col("severity")) >= threshold)), F.lit(False)).alias("severity_tripped"),
        (F.lit(fail_on_unanalyzed) & (F.count_if(F.col("rule_id").isin(*UNANALYZED)) > 0)).alias("unanalyzed_tripped"),
    )
    row = row.crossJoin(posture.select("inert")) if fail_on_inert and posture is not None else row.withColumn("inert", F.lit(False))
    tripped = F.col("severity_tripped") | F.col("unanalyzed_tripped") | F.col("inert")
    asked = fail_on is not None or fail_on_unanalyzed or fail_on_inert
    verdict = F.lit("NOT_EVALUATED") if not asked else F.when(tripped, "FAILED").when(F.lit(files_scanned == 0 or (advisory and fail_on is not None)), "NOT_EVALUATED").otherwise("PASSED")
    return row.select("would_trip_at", "severity_tripped", "unanalyzed_tripped", F.col("inert").alias("inert_tripped"), verdict.alias("verdict"), F.when(verdict == "FAILED", 1).otherwise(0).alias("exit_class"))


def remap(pairs: DataFrame) -> DataFrame:
    """(old_fp, new_fp) that are one to one; fan-in and fan-out drop out."""
    olds = pairs.groupBy("new_fp").agg(F.countDistinct("old_fp").alias("n")).filter("n > 1").select("new_fp")
    one = pairs.groupBy("old_fp").agg(F.min("new_fp").alias("new_fp"), F.max("new_fp").alias("__hi")).filter("new_fp = __hi").drop("__hi")
    return one.join(olds, "new_fp", "left_anti").select("old_fp", "new_fp")


def collisions(pairs: DataFrame) -> DataFrame:
    """Old fingerprints whose verdict can't be carried, and why."""
    fan_in = pairs.groupBy("new_fp").agg(F.countDistinct("old_fp").alias("n")).filter("n > 1").join(pairs, "new_fp").select("old_fp", F.lit("fan-in").alias("why"))
    fan_out = pairs.groupBy("old_fp").agg(F.countDistinct("new_fp").alias("n")).filter("n > 1").select("old_fp", F.lit("fan-out").alias("why"))
    return fan_in.unionByName(fan_out).distinct()


def carry(store: DataFrame, mapping: DataFrame) -> DataFrame:
    """``store`` with new fingerprints; entries without one are marked as orphans."""
    out = store.join(mapping, store.fingerprint == mapping.old_fp, "left")
    return out.select(*[c for c in store.columns if c != "fingerprint"], F.coalesce("new_fp", "fingerprint").alias("fingerprint"), F.col("new_fp").isNull().alias("orphan"))


def fingerprint_collisions(findings: DataFrame) -> DataFrame:
    """Fingerprints of two or more different findings."""
    body = F.to_json(F.struct(*[c for c in findings.columns if c != "fingerprint"]))
    return findings.groupBy("fingerprint").agg(F.countDistinct(body).alias("members")).filter("members > 1")


def duplicate_names(entities: DataFrame, preview: int = 5) -> DataFrame:
    """Names defined more than once, with a preview of the places; the preview keeps few per name."""
    by = Window.partitionBy("qualname").orderBy("path", "line_start")
    counts = entities.groupBy("qualname").count().filter("count > 1").withColumnRenamed("count", "definitions")
    # Only repeated names are sorted: most names stand once.
    first = entities.join(counts, "qualname", "left_semi").withColumn("__k", F.row_number().over(by)).filter(F.col("__k") <= preview)
    shown = first.groupBy("qualname").agg(F.array_sort(F.collect_list(F.struct("path", "line_start"))).alias("places"))
    return counts.join(shown, "qualname")


def baseline_rows(findings: DataFrame) -> DataFrame:
    """What a new baseline holds: defects that no waiver covers, one per fingerprint (the first)."""
    w = Window.partitionBy("fingerprint").orderBy("ordinal")
    return findings.filter((F.col("kind") == "defect") & (F.col("suppression_state") != "waived")).withColumn("__k", F.row_number().over(w)).filter("__k = 1").select("fingerprint", "rule_id", "path", "message")


def judged_rows(entries: DataFrame) -> DataFrame:
    """One judgement per fingerprint: the last."""
    w = Window.partitionBy("fingerprint").orderBy(F.desc("ordinal"))
    return entries.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def entity_trust(entities: DataFrame, findings: DataFrame) -> DataFrame:
    """verdict per declared entity (qualname, declared_rank, actual_rank): defect, unknown or clean."""
    f = findings.filter("qualname IS NOT NULL").groupBy("qualname").agg(
        F.max((F.col("kind") == "defect") & (F.col("suppression_state") == "active")).alias("__active"), F.max(F.col("rule_id").isin(*INCOMPLETE)).alias("__under")
    )
    unknown = F.coalesce("__under", F.lit(False)) | F.col("actual_rank").isNull() | F.col("declared_rank").isNull() | F.col("declared_rank").isin(3, 4, 6)
    verdict = F.when(F.coalesce("__active", F.lit(False)), "defect").when(unknown, "unknown").otherwise("clean")
    return entities.join(f, "qualname", "left").select(*entities.columns, verdict.alias("verdict"))


def decorator_coverage(trust: DataFrame, findings: DataFrame) -> DataFrame:
    """A row per declared entity with its finding state and the number of active and suppressed defects."""
    d = findings.filter((F.col("kind") == "defect") & F.col("qualname").isNotNull()).groupBy("qualname").agg(F.count_if(F.col("suppression_state") == "active").alias("__a"), F.count_if(F.col("suppression_state") != "active").alias("__s"))
    a, s = F.coalesce("__a", F.lit(0)), F.coalesce("__s", F.lit(0))
    state = F.when(a > 0, "defect").when(s > 0, "suppressed").when(F.col("verdict") == "unknown", "unknown").otherwise("clean")
    return trust.join(d, "qualname", "left").select(*trust.columns, state.alias("finding_state"), a.alias("active_findings"), s.alias("suppressed_findings"))


def assurance(trust: DataFrame, unanalyzed: int) -> DataFrame:
    """Coverage posture: the share of boundaries with a definite verdict."""
    total, unknown = F.count(F.lit(1)), F.count_if(F.col("verdict") == "unknown")
    denominator = total + unanalyzed
    return trust.agg(total.alias("boundaries_total"), F.count_if(F.col("verdict") == "clean").alias("proven"), F.count_if(F.col("verdict") == "defect").alias("defect_total"), unknown.alias("unknown_total"), F.when(denominator > 0, F.bround(100 * (total - unknown) / denominator, 1)).alias("coverage_pct"))


def waiver_debt(waivers: DataFrame, today: Column) -> DataFrame:
    return waivers.select("fingerprint", "expires", F.datediff("expires", today).alias("days_left"), "reason")


def resolution_posture(functions: DataFrame, low_resolution: int = 0, least: int = 5) -> DataFrame:
    """``functions`` (source): how many there are, how many declare a boundary, and whether the gate is
    inert: no boundary over at least ``least`` functions."""
    n, b = F.count(F.lit(1)), F.count_if(F.col("source").isin("anchored", "config"))
    return functions.agg(n.alias("functions_analyzed"), b.alias("recognized_boundaries"), F.lit(low_resolution).cast("long").alias("low_resolution_functions"), ((b == 0) & (n >= least)).alias("inert"))


def low_resolution(calls: DataFrame, above: float = 0.70) -> DataFrame:
    """Callers (caller, resolved) most of whose calls lead nowhere known; percent is cut, not rounded."""
    n, lost = F.count(F.lit(1)), F.count_if(~F.col("resolved"))
    return calls.groupBy("caller").agg(n.alias("calls"), lost.alias("unresolved")).filter(F.col("unresolved") / F.col("calls") > above).withColumn("percent", F.floor(F.col("unresolved") * 100 / F.col("calls")).cast("int"))


def unused_directives(configured: DataFrame, matched: DataFrame) -> DataFrame:
    return configured.join(matched, "name", "left_anti")


def sarif_results(findings: DataFrame) -> DataFrame:
    """Result rows of a SARIF run: metrics go; rules are numbered by first appearance (``ordinal``)."""
    kept = findings.filter("kind <> 'metric'")
    # One row per rule: a rule book, not data.
    first = kept.groupBy("rule_id").agg(F.min("ordinal").alias("__first"))
    index = first.withColumn("rule_index", F.row_number().over(Window.orderBy("__first")) - 1).select("rule_id", "rule_index")
    level = F.when(F.col("severity").isin("CRITICAL", "ERROR"), "error").when(F.col("severity") == "WARN", "warning").when(F.col("severity") == "INFO", "note").otherwise("none")
    return kept.join(F.broadcast(index), "rule_id").select("ordinal", "rule_id", "rule_index", level.alias("level"), "path", "line_start", "fingerprint", (F.col("suppression_state") != "active").alias("suppressed"))


def jsonl(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, keys in order, nulls kept."""
    return findings.select(F.to_json(F.struct(*sorted(findings.columns)), {"ignoreNullFields": "false"}).alias("value"))

"""What a scan is written as: JSON lines, SARIF, a bounded summary, signed artifacts, fact tables."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.operators import findings as fo
from credence.operators import ordered
from credence.operators.graphs import _cut

#: Fixed value: the version of the format that is written.
SARIF_VERSION = "2.1.0"


def write_jsonl(findings: DataFrame, path: str) -> None:
    """One object per line, keys in order, nulls kept; the files are written by the executors."""
    fo.jsonl(findings).write.text(path)


def sarif_document(findings: DataFrame, most: int = 100_000) -> dict:
    """One run as a document for the driver; more than ``most`` results stay in the frame of
    ``sarif_results`` instead."""
    rows = fo.sarif_results(findings.withColumn("ordinal", F.monotonically_increasing_id()) if "ordinal" not in findings.columns else findings)
    found = rows.orderBy("ordinal").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} results; write the frame instead")
    rules = [r for r, _ in sorted({(f.rule_id, f.rule_index) for f in found}, key=lambda x: x[1])]
    results = [
        {
            "ruleId": f.rule_id, "ruleIndex": f.rule_index, "level": f.level, "partialFingerprints": {"v2": f.fingerprint},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": f.path}, **({"region": {"startLine": f.line_start}} if f.line_start else {})}}],
            **({"suppressions": [{"kind": "external"}]} if f.suppressed else {}),
        }
        for f in found
    ]
    return {"version": SARIF_VERSION, "runs": [{"tool": {"driver": {"name": "credence", "rules": [{"id": r} for r in rules]}}, "results": results}]}


def sarif_lines(findings: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """(ordinal, value): the lines of one SARIF document of any size, a result on each, rules numbered by first
    appearance.  ``flows`` (fingerprint, code_flow) gives results the steps that their data took, source first."""
    rows = findings if "ordinal" in findings.columns else findings.withColumn("ordinal", F.monotonically_increasing_id())
    rows = _cut(fo.sarif_results(rows))
    steps = F.lit(None).cast("array<string>")
    if flows is not None:
        rows = rows.join(flows.select("fingerprint", "code_flow").dropDuplicates(["fingerprint"]), "fingerprint", "left")
        steps = F.col("code_flow")
    name = lambda q: F.struct(F.struct(F.array(F.struct(q.alias("fullyQualifiedName"))).alias("logicalLocations")).alias("location"))
    region = F.when(F.col("line_start") > 0, F.struct(F.col("line_start").alias("startLine")))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("fingerprint").alias("v2")).alias("partialFingerprints"),
        F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"),
        F.when(F.col("suppressed"), F.array(F.struct(F.lit("external").alias("kind")))).alias("suppressions"),
        F.when(F.size(steps) > 0, F.array(F.struct(F.array(F.struct(F.transform(steps, name).alias("locations"))).alias("threadFlows")))).alias("codeFlows"),
    )
    # The first result has no comma before it; there is one row for each rule.
    top = rows.agg(F.min("ordinal").alias("__top"))
    lines = rows.join(F.broadcast(top)).select("ordinal", F.concat(F.when(F.col("ordinal") == F.col("__top"), "").otherwise(","), F.to_json(result)).alias("value"))
    rules = [r["rule_id"] for r in rows.select("rule_id", "rule_index").distinct().orderBy("rule_index").collect()]
    head = f'{{"version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"credence","rules":{json.dumps([{"id": r} for r in rules])}}}}},"results":['
    ends = rows.sparkSession.createDataFrame([(None, head), (2**63 - 1, "]}]}")], "ordinal long, value string")
    return lines.unionByName(ends)


def write_sarif(findings: DataFrame, path: str, flows: DataFrame | None = None) -> None:
    """The document as text files, written by the executors; in the order of their names they are one document."""
    lines = _cut(sarif_lines(findings, flows))
    lines.orderBy(F.asc_nulls_first("ordinal")).select("value").write.text(path)


def signed_rows(rows: DataFrame, order: list[str], key: bytes) -> tuple[DataFrame, dict]:
    """``rows`` in order with ``number`` and ``digest``, and a signature over all of them; of any size.  The table is to
    be kept with the signature.  ``order`` names columns that tell all rows apart."""
    told = ordered.numbered(rows, [F.col(c) for c in order]).withColumn("digest", ordered.row_digest(rows.columns))
    told = _cut(told)
    return told, _signature(told, key)


def _signature(rows: DataFrame, key: bytes) -> dict:
    count, root = ordered.digest(rows)
    body = {"version": 1, "count": count, "root": root}
    return {**body, "signature": sign(body, key)}


def verify_rows(rows: DataFrame, signature: dict, key: bytes) -> tuple[bool, DataFrame]:
    """(whether the table is the signed one, the rows that don't match their own digest)."""
    own = [c for c in rows.columns if c not in ("number", "digest")]
    now = ordered.row_digest(own)
    changed = rows.filter(~F.col("digest").eqNullSafe(now))
    again = _signature(rows.withColumn("digest", now), key)
    return hmac.compare_digest(json.dumps(again, sort_keys=True), json.dumps(signature, sort_keys=True)), changed


def agent_summary(findings: DataFrame, offset: int = 0, limit: int = 50) -> dict:
    """A bounded summary: counts, and one page of active defects in display order."""
    active = findings.filter("kind = 'defect' AND suppression_state = 'active'")
    rows = [r.asDict(recursive=True) for r in fo.page(active, offset, limit).collect()]
    counts = fo.scan_summary(findings).first().asDict()
    return {"summary": counts, "active": rows, "offset": offset, "limit": limit, "truncated": offset + len(rows) < counts["active"]}


def canonical_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def sign(value, key: bytes) -> str:
    return hmac.new(key, canonical_json(value), hashlib.sha256).hexdigest()


def signed_artifact(findings: DataFrame, key: bytes, most: int = 100_000) -> dict:
    """Findings with their tiers, and a signature over the canonical JSON."""
    own = findings.select("rule_id", "path", "line_start", "qualname", "severity", "fingerprint", "suppression_state", F.col("properties")["tier"].alias("tier"))
    rows = [r.asDict() for r in own.orderBy("path", "rule_id", "fingerprint").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} findings")
    body = {"version": 1, "findings": rows}
    return {**body, "signature": sign(body, key)}


def verify(artifact: dict, key: bytes) -> bool:
    body = {k: v for k, v in artifact.items() if k != "signature"}
    return hmac.compare_digest(sign(body, key), str(artifact.get("signature", "")))


def taint_facts(functions: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON blob per function, keyed by its name and the hash of its body."""
    f = findings.filter("qualname IS NOT NULL").groupBy("qualname").agg(F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"))
    blob = F.to_json(F.struct(F.col("ret").alias("declared_return"), F.col("actual").alias("actual_return"), "source", F.col("ret_callee").alias("contributing_callee"), "fingerprints"))
    return functions.join(f, "qualname", "left").select("qualname", F.col("body_sha").alias("content_sha256"), blob.alias("blob"))


def expired_artifacts(artifacts: DataFrame, keep: int) -> DataFrame:
    """Of artifacts (path, written_at), those beyond the newest ``keep``."""
    order = Window.orderBy(F.desc("written_at"), F.desc("path"))
    return artifacts.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") > keep).drop("__k")


def tracker_rows(findings: DataFrame) -> DataFrame:
    """Rows for an issue tracker; ``mark_unseen`` is false as soon as the analysis was incomplete."""
    severity = F.when(F.col("severity") == "CRITICAL", "critical").when(F.col("severity") == "ERROR", "high").when(F.col("severity") == "WARN", "medium").when(F.col("severity") == "INFO", "low").otherwise("info")
    whole = findings.agg((F.count_if(F.col("rule_id").isin(*fo.INCOMPLETE)) == 0).alias("mark_unseen"))
    return findings.crossJoin(F.broadcast(whole)).select("rule_id", "path", "line_start", severity.alias("severity"), "fingerprint", "mark_unseen")

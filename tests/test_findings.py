from datetime import date

import pytest
from pyspark.sql import functions as F

from credence.operators import findings as fo
from credence.operators import graphs

FINDING = "rule_id string, message string, severity string, kind string, path string, line_start int, qualname string, fingerprint string, properties map<string,string>, suppression_state string, suppression_reason string"


def make(spark, *rows):
    base = {"rule_id": "R", "message": "m", "severity": "ERROR", "kind": "defect", "path": "p.py", "line_start": 1, "qualname": "m.f", "fingerprint": "a", "properties": {}, "suppression_state": "active", "suppression_reason": None}
    names = [c.split()[0] for c in FINDING.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], FINDING)


def test_precedence_and_expiry(spark):
    f = make(spark, *({"fingerprint": x} for x in "abcd"), {"fingerprint": "a", "kind": "fact"})
    baseline = spark.createDataFrame([("a",), ("b",), ("c",)], "fingerprint string")
    waivers = spark.createDataFrame([("a", "today", date(2024, 5, 1)), ("b", "gone", date(2024, 4, 30)), ("d", "open", None)], "fingerprint string, reason string, expires date")
    judged = spark.createDataFrame([("a", "j"), ("c", "jc")], "fingerprint string, rationale string")
    got = {(r.fingerprint, r.kind): (r.suppression_state, r.suppression_reason) for r in fo.suppress(f, baseline, waivers, judged, F.lit("2024-05-01").cast("date")).collect()}
    assert got == {("a", "defect"): ("waived", "today"), ("b", "defect"): ("baselined", None), ("c", "defect"): ("judged", "jc"), ("d", "defect"): ("waived", "open"), ("a", "fact"): ("active", None)}


def test_gate_population_and_verdicts(spark):
    f = make(spark, {"severity": "WARN"}, {"severity": "NONE", "fingerprint": "b"}, {"severity": "CRITICAL", "suppression_state": "waived", "fingerprint": "c"})
    assert fo.gate_decision(f, 3, "ERROR").first().verdict == "PASSED"
    assert fo.gate_decision(f, 3, "ERROR", advisory=True).first().verdict == "NOT_EVALUATED"
    assert fo.gate_decision(f, 0, "ERROR").first().verdict == "NOT_EVALUATED"
    assert fo.gate_decision(f, 3, None).first().verdict == "NOT_EVALUATED"
    assert fo.gate_decision(f, 3, "WARN").first().verdict == "FAILED"
    assert tuple(fo.gate_breakdown(f, "WARN").first()) == (1, 1)


def test_lens(spark):
    f = make(spark, {"path": "src/a/b.py", "properties": {"tier": "ASSURED"}}, {"path": "x.py", "fingerprint": "b"})
    assert fo.where(f, {"path_glob": "src/*.py", "tier": "ASSURED", "severity": "error"}).count() == 1
    for bad in ({"nope": "x"}, {"severity": "LOUD"}):
        with pytest.raises(ValueError):
            fo.where(f, bad)


def test_lineless_defects_and_delta(spark):
    f = make(spark, {"line_start": None}, {"fingerprint": "b", "path": "q.py", "qualname": "m.g"}, {"fingerprint": "c", "rule_id": "WLN-ENGINE-FILE-FAILED", "path": "q.py", "qualname": None})
    out = fo.replace_lineless(f)
    assert {r.rule_id for r in out.collect()} == {fo.LINELESS, "R", "WLN-ENGINE-FILE-FAILED"}
    files, names = spark.createDataFrame([("p.py",)], "path string"), spark.createDataFrame([], "qualname string")
    assert {r.rule_id: r.suppression_state for r in fo.delta_relabel(out, files, names, "x").collect()} == {fo.LINELESS: "active", "R": "baselined", "WLN-ENGINE-FILE-FAILED": "active"}


def test_remap_drops_fan_in_and_fan_out(spark):
    pairs = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3"), ("c", "4"), ("d", "4")], "old_fp string, new_fp string")
    assert [tuple(r) for r in fo.remap(pairs).collect()] == [("a", "1")]
    assert {tuple(r) for r in fo.collisions(pairs).collect()} == {("b", "fan-out"), ("c", "fan-in"), ("d", "fan-in")}


def test_graphs(spark):
    nodes = spark.createDataFrame([("a", 0, False, None), ("b", 1, False, None), ("c", 5, True, 2), ("d", 6, False, None)], "node string, rank int, anchored boolean, returned int")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "caller string, callee string")
    assert {r.node: r["rank"] for r in graphs.propagate(nodes, edges).collect()} == {"a": 2, "b": 2, "c": 5, "d": 6}
    assert {r.node for r in graphs.reachable(spark.createDataFrame([("c",)], "node string"), edges).collect()} == {"a", "b", "c"}
    assert graphs.strongly_connected(edges) == [["d"], ["c"], ["a", "b"]]
    nexts = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node string, next string")
    assert {(r.depth, r.node) for r in graphs.chain(spark.createDataFrame([("a",)], "node string"), nexts).collect()} == {(0, "a"), (1, "b"), (2, "c")}


def test_rollups_of_all_findings(spark, tmp_path):
    from datetime import datetime

    from credence.plans import relational

    rows = [(k, k * 7 % 60, datetime(1995 + k % 3, 1, 1)) for k in range(1, 400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    active, held, names = {}, {}, set()
    for k, c, date in rows:
        q = f"m{c % 50}.C{k % 9}.f"
        names.add(q)
        if k % 11 and k % 7:
            into = held if k % 10 == 0 or k % 4 == 0 or (k % 6 == 0 and date >= datetime(1996, 1, 1)) else active
            into[q] = into.get(q, 0) + 1
    got = {r.qualname: (r.active_findings, r.suppressed_findings) for r in relational.decorator_coverage(spark, str(tmp_path)).collect()}
    assert got == {q: (active.get(q, 0), held.get(q, 0)) for q in names}
    verdicts = {r.qualname: r.verdict for r in relational.entity_trust(spark, str(tmp_path)).collect()}
    assert {q for q, v in verdicts.items() if v == "defect"} == set(active) and set(verdicts) == names
    total = relational.assurance(spark, str(tmp_path)).first()
    assert (total.boundaries_total, total.defect_total) == (len(names), len(active))


def test_walks_from_every_part(spark, tmp_path):
    from credence.plans import relational

    n = 83
    spark.createDataFrame([(k,) for k in range(1, n + 1)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    want = set()
    for start in range(1, n + 1):
        walk, more = [start], True
        while more and len(walk) <= 20:
            after = walk[-1] * 7 % n
            more = 1 <= walk[-1] <= n and after not in walk
            walk += [after] if more else []
        cut = more and 1 <= walk[-1] <= n and walk[-1] * 7 % n not in walk
        want |= {(start, depth, node, cut) for depth, node in enumerate(walk)}
    got = [tuple(r) for r in relational.explain_chain(spark, str(tmp_path)).select("start", "depth", "node", "truncated").collect()]
    assert set(got) == want and len(got) == len(want) and {c for *_, c in want} == {True, False} and max(d for _, d, *_ in want) == 20

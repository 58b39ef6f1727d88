import json
import random

from pyspark.sql import functions as F

from credence.operators import ordered
from credence.sources import sinks


def test_running_sums_and_cuts(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, 1, 2, 3]), r.choice([None, 0, 1, 7])) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, o int, cost long").repartition(7)
    order, total, expected = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0])), 0, {}
    for k, _, cost in order:
        total += cost or 0
        expected[k] = total
    got = ordered.running(df, [F.col("o"), F.col("k")], F.col("cost"), "spent")
    assert {x.k: x.spent for x in got.collect()} == expected and got.columns == ["k", "o", "cost", "spent"]
    cut = ordered.within_budget(df, [F.col("o"), F.col("k")], F.col("cost"), 100).collect()
    assert {x.k for x in cut} == {k for k, spent in expected.items() if spent <= 100}
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert ordered.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_signed_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FANOUT", 3)
    df = spark.createDataFrame([(k, f"m{k}", None if k % 5 else "x") for k in range(40)], "k int, path string, note string")
    kept, signature = sinks.signed_rows(df, ["k"], b"key")
    assert [r.number for r in kept.orderBy("k").collect()] == list(range(40)) and sinks.verify_rows(kept, signature, b"key")[0]
    valid, changed = sinks.verify_rows(kept.withColumn("note", F.when(F.col("k") == 17, "y").otherwise(F.col("note"))), signature, b"key")
    assert not valid and [r.k for r in changed.collect()] == [17]
    assert not sinks.verify_rows(kept, signature, b"other")[0] and not sinks.verify_rows(kept.filter("k <> 3"), signature, b"key")[0]


def test_a_document_of_any_size(spark, tmp_path):
    rows = [(k, f"R{k % 3}", "ERROR", "metric" if k == 0 else "defect", f"p{k}.py", k % 2 or None, f"f{k}", "active" if k % 4 else "waived") for k in range(30)]
    f = spark.createDataFrame(rows, "ordinal long, rule_id string, severity string, kind string, path string, line_start int, fingerprint string, suppression_state string")
    flows = spark.createDataFrame([("f5", ["a.source", "a.mid", "a.end"])], "fingerprint string, code_flow array<string>")
    sinks.write_sarif(f, f"{tmp_path}/sarif", flows)
    text = "".join(p.read_text() for p in sorted((tmp_path / "sarif").glob("part-*")))
    run = json.loads(text)["runs"][0]
    assert [x["id"] for x in run["tool"]["driver"]["rules"]] == ["R1", "R2", "R0"] and len(run["results"]) == 29
    assert [x["partialFingerprints"]["v2"] for x in run["results"]] == [f"f{k}" for k in range(1, 30)]
    assert all(run["tool"]["driver"]["rules"][x["ruleIndex"]]["id"] == x["ruleId"] for x in run["results"])
    steps = run["results"][4]["codeFlows"][0]["threadFlows"][0]["locations"]
    assert [s["location"]["logicalLocations"][0]["fullyQualifiedName"] for s in steps] == ["a.source", "a.mid", "a.end"]
    assert sum("suppressions" in x for x in run["results"]) == 7 and sum("codeFlows" in x for x in run["results"]) == 1

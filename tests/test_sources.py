from datetime import date

import pytest
from pyspark.sql import functions as F

from credence.operators import explain
from credence.plans.scan import scan
from credence.sources import cache, sinks, stores

FP = "a" * 64


def test_stores(spark):
    text = f"fingerprint_scheme: wlfp2\nversion: 1\nwaivers:\n- fingerprint: wlfp2:{FP}\n  reason: later\n  expires: '2024-05-01'\n"
    assert [tuple(r) for r in stores.waivers(spark, text).collect()] == [(FP, "later", date(2024, 5, 1))]
    assert stores.baseline(spark, None).count() == 0
    for bad in (text.replace("wlfp2\n", "wlfp1\n", 1), text.replace(FP, "xyz"), text + f"- fingerprint: wlfp2:{FP}\n  reason: again\n", text.replace("reason: later", "reason: ''")):
        with pytest.raises(stores.StoreError):
            stores.waivers(spark, bad)
    again = stores.write_store("waivers", [{"fingerprint": f"wlfp2:{FP}", "reason": "r", "expires": date(2024, 1, 2)}])
    assert stores.waivers(spark, again).first().expires == date(2024, 1, 2)


def test_config_scope_and_ignore(spark, tmp_path):
    assert stores.config("[credence]\nexclude = ['x']\n")["exclude"] == ["x"]
    for bad in ("[credence]\nnope = 1\n", "[credence]\nexclude = 'x'\n"):
        with pytest.raises(stores.StoreError):
            stores.config(bad)
    assert stores.affected_scope(spark, '{"data": {"items": [{"entity": {"locator": "a.b"}}]}}').first().locator == "a.b"
    with pytest.raises(stores.StoreError):
        stores.affected_scope(spark, "[{}]")
    skip = stores.Ignore(["*.pyc", "build/", "/top.py", "!keep.pyc", "docs/**/x.py", "# note"])
    assert [skip(p) for p in ("a/b.pyc", "keep.pyc", "build/x.py", "a/build/x.py", "top.py", "a/top.py", "docs/q/r/x.py", "docs/x.py", "builder/x.py")] == [True, False, True, True, True, False, True, True, False]
    (tmp_path / "real").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "real")
    assert stores.read_confined(tmp_path, "none") is None
    with pytest.raises(stores.StoreError):
        stores.read_confined(tmp_path, "link")


def test_sinks_explain_and_cache(spark):
    head = "from credence.markers import trusted, external_boundary\n@external_boundary\ndef raw(p):\n    return p\n"
    files = spark.createDataFrame([("m.py", head + "@trusted\ndef f(p):\n    return raw(p)\n")], "path string, source string")
    out = scan(files)
    document = sinks.sarif_document(out["findings"])
    assert document["runs"][0]["results"][0]["ruleId"] == "PY-WL-101"
    artifact = sinks.signed_artifact(out["findings"], b"key")
    assert sinks.verify(artifact, b"key") and not sinks.verify(artifact, b"other") and not sinks.verify({**artifact, "version": 2}, b"key")
    assert sinks.agent_summary(out["findings"])["summary"]["active"] == 1 and sinks.tracker_rows(out["findings"]).first().mark_unseen
    assert sinks.taint_facts(out["functions"], out["findings"]).count() == 2
    row = explain.explain(out["findings"], out["functions"]).first()
    assert (row.immediate_callee, row.code_flow, row.declared, row.actual) == ("m.raw", ["m.raw", "m.f"], "INTEGRAL", "EXTERNAL_RAW")
    assert explain.assurance_of(out, 0).first().coverage_pct == 100.0 and {r.qualname: r.finding_state for r in explain.coverage_of(out).collect()}["m.f"] == "defect"
    kept = files.select("path", cache.cache_key(F.col("path"), F.col("source"), "p").alias("cache_key"))
    hit, miss = cache.split_by_cache(files, kept, "p")
    assert (hit.count(), miss.count()) == (1, 0) and cache.split_by_cache(files, kept, "q")[1].count() == 1


def test_asserts_become_checks():
    source = "def f(p):\n    assert p, 'no'\n    return p\ndef g(p):\n    assert p\n"
    assert explain.replace_asserts(source, {"f"}) == "def f(p):\n    if not (p):\n        raise ValueError('no')\n    return p\ndef g(p):\n    assert p\n"


def test_rescan_of_a_stream(spark, tmp_path):
    from credence.streaming.rescan import rescan

    rows = [("m.py", "from credence.markers import trusted\n@trusted\ndef f(p):\n    return p.fetchone()\n", 2), ("m.py", "def (", 1)]
    spark.createDataFrame(rows, "path string, source string, version int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, source string, version int").parquet(str(tmp_path / "in"))
    seen = []
    query = rescan(stream, str(tmp_path / "checkpoint"), lambda df, epoch: seen.extend(r.rule_id for r in df.collect()))
    query.processAllAvailable()
    query.stop()
    assert "PY-WL-101" in seen and "WLN-ENGINE-PARSE-ERROR" not in seen

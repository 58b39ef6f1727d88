"""Scans whose rules read the functions once: the same findings, and no table of functions or of all rounds is written."""

import pytest

from credence.operators import rules
from credence.operators.findings import duplicate_names
from credence.operators.graphs import enclosing_tier
from credence.plans import scan as plans
from credence.plans.synthetic import HEAD
from credence.sources.discovery import ROOT_BUILD, SKIP_DIRS, in_project

OUTER = "@trusted\ndef f(p):\n    def g(q):\n        os.system(q)\n        def h(r):\n            eval(raw(r))\n        return h(q)\n    return g(raw(p))\n"
FILES = {
    "src/a.py": HEAD + "@trusted\ndef f(cmd):\n    os.system(cmd)\n@trusted\ndef mid(x):\n    f(x)\ndef g(p):\n    mid(raw(p))\n",
    "src/b.py": HEAD + OUTER, "src/c.py": HEAD + "def plain(p):\n    def g(q):\n        eval(raw(q))\n    return g\n", "src/d.py": HEAD + "TOKEN = raw('x')\n@trusted\ndef f(p):\n    return TOKEN\n",
    "src/e.py": HEAD + "def far(p):\n    return 1\n", "src/h.py": "import a\ndef k(p):\n    a.f(p)\n", "src/i.py": "", "src/j.py": "def f(:\n",
}


def _files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, source string")


@pytest.mark.parametrize("rule", [101, 107, 108])
def test_one_rule_writes_no_functions_and_finds_the_same(spark, monkeypatch, rule):
    written, own = [], plans._cut
    monkeypatch.setattr(plans, "_cut", lambda df: written.append(set(df.columns)) or own(df))
    one = plans.scan(_files(spark), rules=(f"PY-WL-{rule}",), diagnose=False)
    assert not any({"actual", "helpers"} <= w for w in written)
    some = plans.scan(_files(spark), rules=(f"PY-WL-{rule}", "PY-WL-102"), diagnose=False)
    assert any({"actual", "helpers"} <= w for w in written)
    rows = lambda out: sorted(tuple(str(r[c]) for c in ("rule_id", "path", "severity", "qualname", "fingerprint", "properties")) for r in out["findings"].filter(f"rule_id <> 'PY-WL-102'").collect())  # noqa: E731, F541
    assert rows(one) == rows(some) and any(f"PY-WL-{rule}" in r for r in rows(one))
    work = lambda out: sorted(map(tuple, out["work"].collect()))
    assert work(one) == work(some)
    # The fixed point takes several rounds, and of a file only the last one counts.
    assert max(step for _, step in work(one)) >= 1
    each = one["functions"].select("path", "qualname", "actual").collect()
    assert len(each) == len(set((r.path, r.qualname) for r in each)) and sorted(map(tuple, each), key=str) == sorted(map(tuple, some["functions"].select("path", "qualname", "actual").collect()), key=str)
    plans.finish(one)
    plans.finish(some)


def test_tiers_are_those_of_all_scopes(spark):
    names = [("m.f", 0, "anchored"), ("m.f.<locals>.g", 6, "fallback"), ("m.f.<locals>.g.<locals>.h", 6, "fallback"), ("m.p", 6, "fallback"), ("m.p.<locals>.g", 2, "anchored"), ("m.p.<locals>.g.<locals>.x", 6, "fallback")]
    seeds = spark.createDataFrame([(q, "m.py", b, s) for q, b, s in names], "qualname string, path string, body int, source string")
    want = enclosing_tier(seeds.selectExpr("qualname", "body AS rank"), seeds.filter("source = 'anchored'").selectExpr("qualname", "body AS rank")).collect()
    assert sorted((r.qualname, r.tier) for r in rules.tiers_of(seeds).collect()) == sorted(map(tuple, want))
    flat = rules.tiers_of(seeds.filter("qualname NOT LIKE '%locals%'"))
    assert "Join" not in flat._jdf.queryExecution().optimizedPlan().toString() and sorted((r.qualname, r.tier) for r in flat.collect()) == [("m.f", 0), ("m.p", 6)]


def test_skipped_directories(spark):
    paths = [f"{at}{d}{end}" for d in (*SKIP_DIRS, *ROOT_BUILD, "my.egg-info", "xvenv", "venv2", "a.git") for at in ("", "src/", "/") for end in ("/x.py", ".py", "")] + ["x.py", "", "/", "a\n/b.egg-info/x.py", "a\nb.egg-info/x.py"]

    def kept(path):
        *dirs, _ = path.split("/")
        return not set(dirs) & set(SKIP_DIRS) and not (dirs and (dirs[0] in ROOT_BUILD or dirs[0].endswith(".egg-info")))

    files = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
    found = in_project(files)
    assert sorted(r.path for r in found.collect()) == sorted(p for p in paths if kept(p))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1


def test_only_repeated_names_are_sorted(spark):
    rows = spark.createDataFrame([("a", "x.py", 2), ("a", "x.py", 1), ("b", "y.py", 1), ("c", "z.py", 1), ("c", "y.py", 7)], "qualname string, path string, line_start int")
    twice = duplicate_names(rows)
    assert {r.qualname: (r.definitions, [tuple(p) for p in r.places]) for r in twice.collect()} == {"a": (2, [("x.py", 1), ("x.py", 2)]), "c": (2, [("y.py", 7), ("z.py", 1)])}
    plan = twice._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan

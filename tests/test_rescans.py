import random

import pytest
from pyspark.sql import functions as F

from credence.functions.flow import blended
from credence.operators import graphs
from credence.plans.scan import finish, scan
from credence.sources import cache

HEAD = "from credence.markers import trusted, external_boundary, trust_boundary\nimport os\n@external_boundary\ndef raw(p):\n    return p\n"
SECRET = b"key"


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, source string")


def found(out):
    return sorted((r.rule_id, r.path, r.qualname or "", r.line_start or 0, r.severity) for r in out["findings"].collect())


def ranks(out):
    return sorted((r.path, r.qualname, r.body, r.actual if r.actual is not None else -1) for r in out["functions"].collect())


def ran(out):
    return {r.path for r in out["work"].filter("step >= 0").collect()}


def project(seed, changed=()):
    """Modules that hand values on to one another, in chains and rings."""
    files = {"src/base.py": HEAD + "@trusted\ndef sink(c):\n    os.system(c)\n"}
    for k in range(8):
        r = random.Random(f"{seed} {k} {k in changed}")
        to = r.randrange(8)
        value = r.choice(["raw(p)", "'x'", "p", "c"])
        files[f"src/m{k}.py"] = (
            f"from base import sink, raw\nfrom m{to} import f{to} as g\nfrom credence.markers import trusted\n@trusted\ndef f{k}(c):\n    {r.choice(['sink(c)', 'pass', 'g(c)', 'return c'])}\n"
            f"class C{k}:\n    def put(self, p):\n        self.x = {r.choice(['p', 'raw(p)', '1'])}\n    @trusted\n    def get(self):\n        {r.choice(['g(self.x)', 'os.system(self.x)'])}\ndef go(p, c):\n    g({value})\n"
        )
    return files


@pytest.mark.parametrize(("seed", "clash"), [(1, False)])
def test_an_incremental_scan_equals_a_full_one(spark, seed, clash):
    settings = {"provenance_clash": clash}
    first = scan(frame(spark, project(seed)), settings=settings, secret=SECRET)
    kept = graphs._cut(first["cache"])
    after = project(seed, (2, 5))
    del after["src/m7.py"]
    full = scan(frame(spark, after), settings=settings)
    part = scan(frame(spark, after), settings=settings, secret=SECRET, cached=kept)
    assert found(part) == found(full) and ranks(part) == ranks(full)
    assert {r.path for r in part["work"].filter("step < 0").collect()} <= {"src/m2.py", "src/m5.py"}
    for out in (first, full, part):
        finish(out)


def test_rows_that_were_changed_count_for_nothing(spark):
    files = {"src/a.py": HEAD + "@trusted\ndef f(p):\n    return raw(p)\n", "src/b.py": "def g(p):\n    return 1\n"}
    first = scan(frame(spark, files), secret=SECRET)
    kept = graphs._cut(first["cache"])
    forged = graphs._cut(kept.withColumn("flows", F.when(F.col("path") == "src/a.py", F.slice("flows", 1, 1)).otherwise(F.col("flows"))))
    assert cache.verified(kept, SECRET).count() == 2 and cache.verified(forged, SECRET).count() == 1 and cache.verified(kept, b"other").count() == 0
    out = scan(frame(spark, files), secret=SECRET, cached=forged)
    assert found(out) == found(first) and ran(out) == {"src/a.py"}
    finish(first)


@pytest.mark.parametrize(("seed", "clash"), [(1, False)])
def test_a_delta_scan_equals_the_full_one_on_its_scope(spark, seed, clash):
    files, settings = project(seed), {"provenance_clash": clash}
    full = scan(frame(spark, files), settings=settings, diagnose=False)
    for name in ("m5.C5",):
        scope = spark.createDataFrame([(f"python:function:{name}", None)], "locator string, sei string")
        out = scan(frame(spark, files), settings=settings, diagnose=False, scope=scope)
        mine = lambda rows: [x for x in rows if x[2] == name or x[2].startswith(f"{name}.")]
        assert found(out) == mine(found(full)) == mine(found(out))
        assert out["report"].first().mode == "delta" and out["report"].first().files_analyzed <= len(files)
        finish(out)
    finish(full)


def test_a_scope_of_unknown_names_means_a_full_scan(spark):
    scope = spark.createDataFrame([("python:function:no.where", None)], "locator string, sei string")
    out = scan(frame(spark, {"src/a.py": HEAD + "@trusted\ndef f(p):\n    return raw(p)\n"}), diagnose=False, scope=scope)
    report = out["report"].first()
    assert (report.mode, report.gate_authority, report.unresolved_count, report.in_scope_findings) == ("full-fallback", "gate-of-record", 1, 1)


def test_the_provenance_join():
    assert [blended(a, b) for a, b in ((0, 1), (0, 5), (5, 6), (3, 6), (3, 4), (4, 6), (2, 2), (7, 1))] == [7, 7, 7, 6, 4, 6, 2, 7]
    assert blended((), default=0) == 0 and blended([3]) == 3


@pytest.mark.parametrize("clash", [False, True])
def test_fixed_point_by_frontiers(spark, clash):
    r = random.Random(9)
    names = [f"n{k}" for k in range(60)]
    nodes = [(n, 6, False, None) if k % 3 else (n, r.choice([0, 1, 2, 5]), True, r.choice([0, 1, 5])) for k, n in enumerate(names)]
    edges = [(r.choice(names), r.choice(names)) for _ in range(50)]
    now = {n: rank for n, rank, *_ in nodes}
    fixed = {n: returned for n, _, anchored, returned in nodes if anchored}
    callees = {n: {b for a, b in edges if a == n} for n in names}
    moved = True
    while moved:
        moved = False
        for n in names:
            given = [fixed.get(c, now[c]) for c in callees[n]]
            to = (blended if clash else max)(given, default=0)
            if n not in fixed and to > now[n]:
                now[n], moved = to, True
    got = graphs.semi_naive(spark.createDataFrame(nodes, "node string, rank int, anchored boolean, returned int"), spark.createDataFrame(edges, "caller string, callee string"), clash)
    assert {x.node: x["rank"] for x in got.ranks.collect()} == now
    for x in got.changes.collect():  # the callee that a rank came from is the weakest at the time
        assert x.via in callees[x.node]
    assert sum(got.touched) == got.changes.count() if not clash else got.touched


def test_clash_mode_changes_what_is_found(spark):
    text = HEAD + "@trusted(level='ASSURED')\ndef kept(p):\n    return 'a'\n@trusted(level='ASSURED')\ndef f(c):\n    if c:\n        x = kept(c)\n    else:\n        x = 'b'\n    return x\ndef mixes(p):\n    if p:\n        return raw(p)\n    return kept(p)\n"
    rows = {}
    for on in (False, True):
        out = scan(frame(spark, {"src/m.py": text}), settings={"provenance_clash": on}, diagnose=False)
        rows[on] = {r.qualname: (r.actual, r.source, r.via) for r in out["functions"].collect()}
        assert ("PY-WL-101" in [x[0] for x in found(out)]) == on
        finish(out)
    assert rows[False]["m.f"][0] == 1 and rows[True]["m.f"][0] == 7
    assert rows[False]["m.mixes"] == (5, "fallback", None) and rows[True]["m.mixes"] == (7, "callgraph", "m.raw")

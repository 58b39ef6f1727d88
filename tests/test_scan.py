import ast

import pytest

from credence.functions.flow import Flow
from credence.operators import findings as fo
from credence.plans.scan import extract, finish, flow, scan, seed
from credence.sources.python_code import Source, exits, flow_rows, module_of, quoted_command

HEAD = "from credence.markers import trusted, external_boundary, trust_boundary\nimport os, shlex, html, json\n@external_boundary\ndef raw(p):\n    return p\n"


def ranks(body: str, rank: int = 0) -> Flow:
    node = ast.parse("def f(p):\n" + "".join(f"    {line}\n" for line in body.split("\n"))).body[0]
    return Flow(node, rank, {"html": "html", "esc": "html.escape", "loads": "json.loads"}, {"m.raw": 5}.get, "m", None, {})


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("return 1", 0), ("return raw(1)", 5), ("x = raw(1)\nx = 1\nreturn x", 0), ("x = 1\nif p:\n    x = raw(1)\nreturn x", 5), ("return 'a' + raw(1)", 5), ("return f'{raw(1)}'", 5),
        ("return [raw(1)][0]", 5), ("return {raw(1): 2}", 0), ("return {k: raw(k) for k in p}", 5), ("return raw(1) == 2", 0), ("return len(raw(1))", 0), ("return str(raw(1))", 5),
        ("return esc('a')", 2), ("return esc(raw(1))", 5), ("return loads('1')", 6), ("x = []\nx.append(raw(1))\nreturn x", 5), ("a, b = 1, raw(1)\nreturn a", 0), ("a, b = raw(1)\nreturn a", 5),
        ("for x in raw(1):\n    pass\nreturn x", 5), ("y = 0\nwhile p:\n    z = y\n    y = raw(1)\nreturn z", 5), ("x = 1\ntry:\n    x = raw(1)\n    x = 2\nexcept E:\n    return x", 5),
        ("with open('f') as g:\n    return g", 5), ("return '{}'.format(raw(1))", 5), ("return p.get('k', raw(1))", 5), ("f = lambda a: a\nreturn f(raw(1))", 5), ("return c.fetchone()", 5),
        ("match p:\n    case 1:\n        x = raw(1)\n    case _:\n        x = 2\nreturn x", 5), ("x = 1\nx += raw(1)\nreturn x", 5), ("return (y := raw(1)) and y", 5), ("pass", None),
    ],
)
def test_ranks_of_returned_values(body, expected):
    assert ranks(body).ret == expected


def test_modules_and_entities():
    assert [module_of(p) for p in ("demo.py", "src/demo.py", "src.py", "pkg/__init__.py", "src/src/pkg/mod.py", "__init__.py")] == ["demo", "demo", "src", "pkg", "src.pkg.mod", None]
    text = "from typing import overload\nclass C:\n    @property\n    def x(self): pass\n    @x.setter\n    def x(self, v): pass\n    @overload\n    def o(self): pass\ndef f():\n    def g(): pass\ndef f(): pass\n"
    assert set(Source("m.py", text).entities) == {"m.C.x", "m.C.x:setter", "m.f"}


def test_a_project(spark):
    files = [
        ("src/app/a.py", HEAD + "@trusted(level='ASSURED')\ndef build(p):\n    return raw(p)\n@trusted\ndef run(p):\n    os.system('ls ' + shlex.quote(raw(p)))\n    os.system(shlex.quote(raw(p)) + ' x')\n"),
        ("src/app/b.py", "from credence.markers import trusted\nimport os\nfrom app.a import raw\n@trusted\ndef sink(c):\n    os.system(c)\ndef go():\n    sink(raw(1))\n"),
        ("src/app/bad.py", "def ("),
        ("src/app/bytes.py", "x = 1\n"),
    ]
    found = scan(spark.createDataFrame(files, "path string, source string"))["findings"]
    rows = sorted((r.rule_id, r.qualname, r.severity) for r in found.filter("kind = 'defect'").collect())
    assert rows == [
        ("PY-WL-101", "app.a.build", "ERROR"), ("PY-WL-105", "app.b.go", "ERROR"), ("PY-WL-108", "app.a.run", "ERROR"), ("PY-WL-108", "app.b.sink", "ERROR"), ("WLN-ENGINE-PARSE-ERROR", None, "ERROR"),
    ]
    gate = fo.gate_decision(found, 4, "ERROR").first()
    assert (gate.verdict, gate.would_trip_at, gate.exit_class) == ("FAILED", "ERROR", 1)


def chain(n):
    body = "".join(f"@trusted\ndef f{i}(c):\n    f{i + 1}(c)\n    return c\n" for i in range(n))
    return [("src/chain.py", HEAD + body + f"@trusted\ndef f{n}(c):\n    os.system(c)\ndef go():\n    f0(raw(1))\n")]


def test_a_chain_of_more_than_40_calls(spark):
    found = scan(spark.createDataFrame(chain(42), "path string, source string"), rules=("PY-WL-108",), diagnose=False)["findings"].collect()
    assert [(r.rule_id, r.qualname) for r in found] == [("PY-WL-108", "chain.f42")]


def test_functions_past_the_bound_return_unknown(spark):
    files = spark.createDataFrame(chain(4), "path string, source string")
    facts = extract(files)
    seeds = seed(facts.selectExpr("explode(entities) AS e").select("e.*"))
    out, settled = flow(files, facts, seeds, rounds=2)[:2]
    ret = {r.qualname: r.ret for r in out.collect()}
    assert not settled and [ret[f"chain.f{i}"] for i in range(5)] == [6, 6, 6, 6, None]
    out, settled = flow(files, facts, seeds)[:2]
    assert settled and {r.ret for r in out.collect() if r.qualname in ("chain.f0", "chain.f3")} == {5}


def test_undecodable_source_is_a_finding(spark):
    df = spark.createDataFrame([("a.py", bytearray(b"\xff\xfe"))], "path string, source binary")
    assert [r.rule_id for r in scan(df)["findings"].filter("kind = 'defect'").collect()] == ["WLN-ENGINE-FILE-FAILED"]


def test_no_files(spark):
    out = scan(spark.createDataFrame([], "path string, source string"))
    assert out["findings"].filter("kind = 'defect'").count() == 0
    assert fo.gate_decision(out["findings"], 0, "ERROR").first().verdict == "NOT_EVALUATED"


@pytest.mark.parametrize(
    ("body", "ways"),
    [
        ("while True:\n    for x in y:\n        break", ""), ("while True:\n    if x:\n        break", "next"), ("with a:\n    raise E", "raise"), ("try:\n    f()\nexcept E:\n    return 1", "next return"),
        ("try:\n    return f()\nexcept E:\n    raise", "raise return"), ("if a:\n    return 1\nelse:\n    raise E", "raise return"), ("for x in y:\n    return x", "next return"),
        ("match a:\n    case 1:\n        return 1\n    case _:\n        raise E", "raise return"), ("match a:\n    case 1:\n        return 1", "next return"), ("try:\n    f()\nfinally:\n    return 1", "return"),
    ],
)
def test_exits(body, ways):
    assert " ".join(sorted(exits(ast.parse(body).body))) == ways


def test_quoted_commands():
    quoted = lambda text: quoted_command(ast.parse(text, mode="eval").body, {"q": "shlex.quote"})
    assert quoted("'ls ' + q(x)") and quoted("f'ls {q(x)} -l'") and not quoted("q(x) + ' ls'") and not quoted("'  ' + q(x)") and not quoted("'ls ' + x") and not quoted("'ls'")


def test_a_rule_that_fails_is_a_finding(spark, monkeypatch):
    from credence.operators import rules

    monkeypatch.setitem(rules.EXTRA, "XX-1", lambda functions, calls, seeds: functions.select("no_such_column"))
    monkeypatch.setitem(rules.EXTRA, "XX-2", lambda functions, calls, seeds: functions.selectExpr("raise_error('in a task') AS rule_id"))
    out = scan(spark.createDataFrame([("a.py", HEAD + "@trusted\ndef f(p):\n    return raw(p)\n")], "path string, source string"))
    assert sorted(r.rule_id for r in out["findings"].filter("kind = 'defect'").collect()) == ["PY-WL-101", "WLN-ENGINE-RULE-FAILED", "WLN-ENGINE-RULE-FAILED"]
    finish(out)


def test_methods_help_their_boundary(spark):
    text = HEAD + "class C:\n    @trust_boundary(to_level='GUARDED')\n    def f(self, p):\n        self.check(p)\n        return (p, 1)\n    def check(self, p):\n        raise ValueError\n"
    out = scan(spark.createDataFrame([("a.py", text)], "path string, source string"), rules=("PY-WL-102",), diagnose=False)
    assert out["findings"].count() == 0


def test_project_functions_come_before_the_library():
    assert Flow(ast.parse("def f(p):\n    return json.loads(p)").body[0], 0, {"json": "json"}, {"json.loads": 0}.get, "m", None, {}).ret == 0


@pytest.mark.parametrize(
    ("body", "lines"),
    [
        ("x = c.fetchone()\nput(x)", [("put", 3)]), ("put(open('f').read())", []), ("x = c.read()\ny = x\nz, w = 1, y\nput(w)\nreturn w", [("put", 5), ("return", 6)]),
        ("b = io.BytesIO(p)\nx = b.read()\nput(x)\nreturn x", []), ("x = c.read()\nreturn lambda: x", [("return", 3)]), ("x: str = os.read(3, 9)\nother(x)\nreturn 1", []), ("put(c.read())\nreturn c.read()", [("put", 2), ("return", 3)]),
    ],
)
def test_what_holds_stored_data(body, lines):
    text = "import io, os\ndef put(a): pass\n" + "def f(c, p):\n" + "".join(f"    {line}\n" for line in body.split("\n"))
    src = Source("m.py", text)
    row = next(r for r in flow_rows(src, {"m.put": (0, 0, ["a"]), "m.f": (0, 0, ["c", "p"])}, {}) if r["qualname"] == "m.f")
    found = [(c["dotted"], c["line"] - 2) for c in row["calls"] if c["stored"] and c["callee"]] + [("return", r["line"] - 2) for r in row["stored_returns"]]
    assert found == lines


def test_stored_data_handed_to_a_trusted_callee(spark):
    text = HEAD + "@trusted\ndef put(a):\n    return 1\ndef note(a):\n    return 1\n@trusted\ndef f(c):\n    x = c.fetchone()\n    put(x)\n    note(x)\n    return x\ndef g(c):\n    x = c.fetchone()\n    put(x)\n"
    out = scan(spark.createDataFrame([("a.py", text)], "path string, source string"), rules=("PY-WL-120",), diagnose=False)
    assert sorted((r.qualname, r.line_start, r.severity) for r in out["findings"].collect()) == [("a.f", 14, "ERROR"), ("a.f", 16, "ERROR")]
    finish(out)

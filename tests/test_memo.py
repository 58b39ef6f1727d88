"""Texts that a worker has met before: the same rows as by reading each file, with less reading."""

import json

import pyarrow as pa
import pytest

from credence.plans import scan
from credence.plans.rescans import MEETING, PASSES, RINGS, ROUTES, SINK, STARS, TAKES, WEB
from credence.plans.synthetic import HEAD, SHAPES
from credence.sources import memo, python_code

MARKS = python_code.MARKER_MODULES
TEXTS = [HEAD + o for _, options, _ in SHAPES.values() for o in options] + [MEETING + r for r in RINGS] + [SINK, PASSES, STARS, *TAKES, *(WEB + r for r in ROUTES)]
TEXTS += [
    "from . import near\ndef f(p):\n    return near.g(p)\n", "import alpha\nx = alpha.y\ndef f(p):\n    return alpha.f(p)\n", "def f(:\n", "", "class A:\n    def go(self, p):\n        self.x = p\n        self.stop()\n    def stop(self):\n        return self.x\n",
    "X = loads('a')\ndef loads(p):\n    return p\ndef Depends(p):\n    return p\ndef f(p=Depends(loads)):\n    global X\n    X = open(p)\n    return X\n", "def f(p):\n    return '\\udc80' + p + 'é'\n", "def f(p):\n    def g(q):\n        return h(q)\n    return g(p)\n",
]
PATHS = ["src/alpha.py", "src/zeta.py", "pkg/beta.py", "src/json.py", "src/fastapi.py", "src/a.py", "pkg/__init__.py", "src/alpha/near.py", "no module.txt"]


@pytest.mark.parametrize("clash", [False, True])
def test_rows_are_those_of_the_file_itself(clash):
    for text in TEXTS:
        for path in PATHS:
            facts = memo.facts(path, text, MARKS)
            assert facts == memo._facts(path, text, MARKS)
            own = [{"qualname": e["qualname"], "body": 6 - k % 2, "ret": 6, "params": e["params"], "real": None} for k, e in enumerate(facts["entities"])]
            for seeds in (own, [*own, {"qualname": "q{k}.run", "body": 0, "ret": 0, "params": ["c"], "real": "m{k}.sink"}, {"qualname": "other.f", "body": 5, "ret": 5, "params": ["p"], "real": None}]):
                meets = [{"callee": e["qualname"], "param": p, "rank": 7} for e in facts["entities"][:1] for p in e["params"][:1]] + [{"callee": f"{facts.get('module')}#", "param": "X", "rank": 6}]
                got = memo.flows(path, text, seeds, meets, MARKS, {"near.g": 5}, clash)
                assert got == memo._flows(path, text, seeds, meets, MARKS, {"near.g": 5}, clash)


def test_a_text_is_parsed_once(monkeypatch):
    read, own = [], python_code.parsed
    monkeypatch.setattr(python_code, "parsed", lambda *a: read.append(a[0]) or own(*a))
    text = HEAD + "def once(p):\n    return raw(p)\n"
    for k in range(20):
        assert memo.facts(f"src/n{k}.py", text, MARKS)["entities"][1]["qualname"] == f"n{k}.once"
    assert len(read) == 1


def test_what_is_kept_is_bounded():
    for k in range(memo.MOST + 50):
        memo.facts("src/n1.py", f"def f(p):\n    return {k}\n", MARKS)
    assert len(memo._kept) <= memo.MOST and 0 < memo._chars <= memo.MOST_CHARS


@pytest.mark.parametrize("clash", [False, True])
def test_batches_hold_the_rows_of_each_file(spark, clash):
    """Also where files that share a text, those that are read by themselves and parse errors are mixed."""
    facts_schema, flow_schema = scan._arrow(scan.FACTS), scan._arrow(scan.FLOW)
    files = [{"path": p, "source": t} for t in [*TEXTS, *TEXTS[:7]] for p in PATHS] + [{"path": "src/raw.py", "source": None}]
    batch = pa.RecordBatch.from_pylist(files, schema=pa.schema([("path", "string"), ("source", "string")]))
    same = lambda rows: sorted(json.dumps(r | {"references": sorted(r["references"])} if "references" in r else r, sort_keys=True) for r in rows)
    plain = lambda rows, schema: pa.RecordBatch.from_pylist(rows, schema=schema).to_pylist()
    want = [memo._facts(f["path"], f["source"], MARKS) for f in files]
    assert same(r for b in memo.fact_batches(batch, MARKS, facts_schema) for r in b.to_pylist()) == same(plain(want, facts_schema))
    for f, w in zip(files, want):
        seeds = [{"qualname": e["qualname"], "body": 6 - k % 2, "ret": 6, "params": e["params"]} for k, e in enumerate(w["entities"])] + [{"qualname": "q{k}.run", "body": 0, "ret": 0, "params": ["c"], "real": "m{k}.sink"}]
        f["seeds"], f["meets"] = json.dumps(seeds, ensure_ascii=False), json.dumps([{"callee": e["qualname"], "param": p, "rank": 7} for e in w["entities"][:1] for p in e["params"][:1]]) if len(f["path"]) % 2 else None
    batch = pa.RecordBatch.from_pylist(files, schema=pa.schema([(c, "string") for c in ("path", "source", "seeds", "meets")]))
    flows = [r for f in files for r in memo._flows(f["path"], f["source"], json.loads(f["seeds"]), json.loads(f["meets"] or "[]"), MARKS, {"near.g": 5}, clash)]
    assert same(r for b in memo.flow_batches(batch, MARKS, {"near.g": 5}, clash, flow_schema) for r in b.to_pylist()) == same(plain(flows, flow_schema))


def test_rows_of_a_text_are_made_once_for_many_files(spark, monkeypatch):
    made, own, schema = [], json.loads, scan._arrow(scan.FACTS)
    monkeypatch.setattr(memo.json, "loads", lambda text: made.append(text) or own(text))
    files = pa.RecordBatch.from_pylist([{"path": f"src/n{k}.py", "source": HEAD + SHAPES[120][1][k % 5]} for k in range(4_000)])
    assert sum(b.num_rows for b in memo.fact_batches(files, MARKS, schema)) == 4_000
    assert len(made) <= 5 * (4_000 // memo.FILES + 1)


def test_of_functions_only_what_is_named_is_read(spark):
    facts = scan._cut(scan.extract(spark.createDataFrame([("src/n.py", HEAD + "class A:\n    def go(self, p):\n        return p\n")], "path string, source string")))
    rows = scan.members(facts, "qualname", "owner", "params")
    assert sorted(map(tuple, rows.collect())) == [("src/n.py", "n", "n.A.go", "n.A", ["self", "p"]), ("src/n.py", "n", "n.raw", None, ["p"])]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "qualname" in plan and "body_sha" not in plan

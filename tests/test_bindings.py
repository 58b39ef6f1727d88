import random

import pytest

from credence.operators import bindings
from credence.plans.scan import extract, finish, scan
from credence.sources.python_code import Source

HEAD = "from credence.markers import trusted, external_boundary\nimport os\n@external_boundary\ndef raw(p):\n    return p\n"


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, source string")


def found(out):
    return sorted((r.rule_id, r.qualname, r.properties.get("arg_taint")) for r in out["findings"].collect())


def test_a_chain_of_40_bindings_takes_7_rounds(spark):
    rows = [(f"m{k}.f", f"m{k + 1}.f") for k in range(40)] + [("r.a", "r.b"), ("r.b", "r.c"), ("r.c", "r.a"), ("r.d", "r.a"), ("s.x", "s.x")]
    random.Random(1).shuffle(rows)
    got = bindings.canonical(spark.createDataFrame(rows, "name string, target string"))
    assert {r.name: r.target for r in got.canonical.collect()} == {f"m{k}.f": "m40.f" for k in range(40)} and got.rounds <= 7


def test_reexports_and_star_imports_are_followed(spark):
    files = {
        "src/core.py": HEAD + "@trusted\ndef sink(c):\n    os.system(c)\ndef _hidden(c):\n    return c\n",
        "src/pkg/__init__.py": "from core import sink as run\nfrom .inner import *\n",
        "src/pkg/inner.py": "from core import *\n",
        "src/listed.py": "__all__ = ['run']\nfrom pkg import *\n",
        "src/a.py": "from pkg import run, raw\ndef go(p):\n    run(raw(p))\n",
        "src/b.py": "from listed import *\nimport pkg\ndef go(p):\n    run(pkg.raw(p))\n",
        "src/c.py": "from credence.markers import *\nimport pkg.inner as i\n@trusted\ndef f(p):\n    return i.raw(p)\n",
    }
    facts = extract(frame(spark, files))
    stars = {r.name: r.target for r in bindings.star_bindings(facts).collect()}
    assert stars["listed.run"] == "pkg.run" and stars["pkg.raw"] in ("pkg.inner.raw", "core.raw") and "pkg.inner._hidden" not in stars and "pkg.run" not in stars
    out = scan(frame(spark, files), diagnose=False)
    assert [x for x in found(out) if x[0] != "PY-WL-108"] == [("PY-WL-101", "c.f", None), ("PY-WL-105", "a.go", "EXTERNAL_RAW"), ("PY-WL-105", "b.go", "EXTERNAL_RAW")]
    assert [x[1] for x in found(out) if x[0] == "PY-WL-108"] == ["core.sink"]
    finish(out)


def model_facts(spark, chain=3):
    files = {"src/a.py": "import pydantic\nclass A(pydantic.BaseModel):\n    x: int\nclass A2(A):\n    pass\nclass No:\n    pass\n"}
    for k in range(chain):
        files[f"src/m{k}.py"] = f"from {'a import A2' if not k else f'm{k - 1} import M{k - 1}'} as Base\nclass M{k}(Base):\n    pass\n"
    return extract(frame(spark, files))


def test_models_are_found_across_files(spark):
    facts = model_facts(spark)
    got = bindings.model_closure(facts, bindings.project_aliases(facts))
    assert {r.qualname for r in got.models.collect()} == {"a.A", "a.A2", "m0.M0", "m1.M1", "m2.M2"} and got.degraded is None
    # Four rounds find something, each with 4 files and 10 statements, and a fifth that nothing is left.
    statements, files, known = 10, 4, [0, 2, 3, 4, 5]
    work = sum(statements + files * (n + 1) for n in known)
    assert bindings.model_closure(facts, None, most=work).degraded is None
    past = bindings.model_closure(facts, None, most=work - 1)
    assert past.degraded["reason"] == "work_budget_exceeded" and past.degraded["round"] == 5 and "a.No" in {r.qualname for r in past.models.collect()}


def test_a_search_past_its_budget_is_a_finding(spark, monkeypatch):
    monkeypatch.setattr(bindings, "MOST_WORK", 3)
    text = "import fastapi\nfrom credence.markers import trusted\nimport os\napp = fastapi.FastAPI()\nclass Item:\n    pass\n@app.post('/')\n@trusted\ndef put(item: Item):\n    os.system(item.x)\n"
    out = scan(frame(spark, {"src/m.py": text}))
    rules = {r.rule_id for r in out["findings"].filter("kind = 'defect'").collect()}
    assert rules == {"PY-WL-108", "WLN-ENGINE-PYDANTIC-DISCOVERY-LIMIT"}
    finish(out)


def test_what_a_request_holds_reaches_a_sink_through_two_dependencies(spark):
    files = {
        "src/deps.py": "from fastapi import Depends, Request\nfrom typing import Annotated\ndef first(request: Request):\n    return request.query_params['q']\ndef second(q=Depends(first)):\n    return q\ndef fixed():\n    return 'x'\n",
        "src/app.py": "import os\nfrom fastapi import APIRouter, Depends\nfrom typing import Annotated\nfrom credence.markers import trusted\nfrom deps import second, fixed\nr = APIRouter()\n"
        "@r.get('/a')\n@trusted\ndef a(v=Depends(second)):\n    os.system(v)\n@r.get('/b')\n@trusted\ndef b(v: Annotated[str, Depends(fixed)]):\n    os.system(v)\n@r.get('/c')\n@trusted\ndef c(v=Depends(unknown)):\n    os.system(v)\n",
        "src/body.py": "import os\nfrom fastapi import FastAPI\nfrom typing import Optional\nfrom credence.markers import trusted\nfrom models import Order\nmain = FastAPI()\n"
        "@main.post('/')\n@trusted\ndef put(order: Optional[Order], n: int = 1):\n    os.system(order.text)\n@trusted\ndef other(order: Order):\n    os.system(order.text)\n",
        "src/models.py": "from pydantic import BaseModel\nclass Base(BaseModel):\n    pass\nclass Order(Base):\n    pass\n",
    }
    out = scan(frame(spark, files), rules=("PY-WL-108",), diagnose=False)
    assert found(out) == [("PY-WL-108", "app.a", "EXTERNAL_RAW"), ("PY-WL-108", "app.c", "UNKNOWN_RAW"), ("PY-WL-108", "body.put", "EXTERNAL_RAW")]
    finish(out)


@pytest.mark.parametrize(
    ("annotation", "names"),
    [
        ("int", ["m.int"]), ("Optional[A]", ["m.A"]), ("A | None", ["m.A"]), ("'A'", ["m.A"]), ("'A['", ["?"]), ("list[A]", ["m.list", "m.A"]), ("Annotated[A, 1]", ["m.A"]), ("''", []), ("x.B", ["x.B"]), ("f()", []),
    ],
)
def test_types_of_annotations(annotation, names):
    src = Source("m.py", f"from typing import Optional, Annotated\nimport x\ndef f(a: {annotation}): pass\n")
    assert src.types(src.entities["m.f"][0].args.args[0].annotation) == names


def test_module_facts():
    src = Source("src/p/__init__.py", "from .a import b as c\nfrom q import *\nimport os\nx = c.d\ndef c(): pass\ny = 1\nclass K(x, Generic[T]): pass\n__all__ = ['x', 'c']\n")
    facts = src.module_facts()
    assert {(b["name"], b["target"]) for b in facts["bindings"]} == {("p.os", "os"), ("p.x", "p.a.b.d")}
    assert (facts["stars"], facts["exports"], facts["classes"], facts["statements"]) == (["q"], ["x", "c"], [{"qualname": "p.K", "bases": ["p.x", "p.Generic"]}], 8)



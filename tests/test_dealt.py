"""How a scan deals its rows: texts are never sent whole to all workers."""

import pytest

from credence.plans import scan as plans
from credence.plans.synthetic import HEAD

FILES = {f"src/m{i}.py": HEAD + f"TOKEN = raw('{i}')\n@trusted\ndef f(p):\n    eval(p)\n    return TOKEN\ndef g(p):\n    f(raw(p))\n" for i in range(6)} | {"venv/x.py": HEAD + "@trusted\ndef f(p):\n    return raw(p)\n", "src/venv/y.py": "def f(:\n"}


@pytest.mark.parametrize("rule", [101, 107])
def test_texts_are_dealt_and_never_broadcast(spark, monkeypatch, rule):
    written, own = [], plans._cut

    def cut(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "MapInArrow" in plan:
            written.append((plan, df._jdf.queryExecution().optimizedPlan().toString()))
        return own(df)

    monkeypatch.setattr(plans, "_cut", cut)
    out = plans.scan(spark.createDataFrame(list(FILES.items()), "path string, source string"), rules=(f"PY-WL-{rule}",), diagnose=False)
    found = {r.path for r in out["findings"].collect()}
    assert found == {f"src/m{i}.py" for i in range(6)}
    _, *rounds = written
    # The facts, and at least two rounds; each meets its texts by the path and no other way, and filters them no more.
    assert len(rounds) >= 2
    for physical, logical in rounds:
        # Names alone may be broadcast: those of a round's files (left-semi) and those that were told (by callee).
        by_path = [line for line in physical.splitlines() if "Join [path#" in line and "Inner" in line]
        assert by_path and all("SortMergeJoin" in line for line in by_path)
        assert "RLIKE" not in logical
    plans.finish(out)

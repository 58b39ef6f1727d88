"""Tables with a row for each file or name of a project are dealt by the names; none goes whole through the driver."""

from pyspark.sql import functions as F

from credence.operators import bindings, graphs
from credence.plans import scan as plans
from credence.plans.rescans import RAW, SAFE, SINK, _files

SECRET = b"key"


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_a_scan_with_a_cache_broadcasts_only_its_fixed_tables(spark, monkeypatch):
    part, seen = spark.range(6).withColumnRenamed("id", "p_partkey"), []
    own = graphs._cut

    def cut(df):
        seen.append((broadcasts(df), df.columns))
        return own(df)

    monkeypatch.setattr(plans, "_cut", cut)
    # A computed text looks as small to the planner as the key that it was made of.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        first = plans.scan(_files(part, m=SINK, a=SAFE), rules=("PY-WL-108",), diagnose=False, secret=SECRET)
        assert broadcasts(first["cache"]) == 0
        kept = own(first["cache"])
        second = plans.scan(_files(part, m=SINK, a=F.when(F.col("p_partkey") < 2, RAW).otherwise(SAFE)), rules=("PY-WL-108",), diagnose=False, secret=SECRET, cached=kept)
        assert {r.path for r in second["findings"].collect()} == {"src/m0.py", "src/m1.py"}
        assert {r.path for r in second["work"].filter("step < 0").collect()} == {"src/a0.py", "src/a1.py"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen and [columns for n, columns in seen if n] == []
    for out in (first, second):
        plans.finish(out)


def test_meanings_are_looked_up_by_dealt_names(spark):
    known = spark.createDataFrame([("a.f",), ("b.g",)], "qualname string")
    found = bindings.meanings(spark.createDataFrame([("c.h",), ("a.f",), ("os.x",)], "name string"), spark.createDataFrame([("c.h", "b.g")], "name string, target string"), known)
    assert broadcasts(found) == 0
    assert [tuple(r) for r in found.collect()] == [("c.h", "b.g")]


def test_what_very_many_names_are_bound_to_is_not_dealt_to_one_task(spark, monkeypatch):
    texts = {f"src/r{i}.py": f"import os\nfrom order import Order, os as o\nfrom d{i % 2} import f\n" for i in range(6)} | {f"src/d{i}.py": "def f():\n    pass\n" for i in range(2)} | {"src/order.py": "import os\nclass Order:\n    pass\n"}
    facts = graphs._cut(plans.extract(spark.createDataFrame(list(texts.items()), "path string, source string")))
    rows = lambda: sorted(map(tuple, bindings.project_aliases(facts).select("name", "target").collect()))
    plain = rows()
    assert plain == sorted([(f"r{i}.Order", "order.Order") for i in range(6)] + [(f"r{i}.f", f"d{i % 2}.f") for i in range(6)])
    monkeypatch.setattr(bindings, "HOT", 4)  # now the class and two modules are such, the functions aren't
    assert rows() == plain
    every = bindings.own_bindings(facts)
    keys = graphs._cut(spark.createDataFrame([("order.Order",), ("d0.f",)], "target string"))
    counts = every.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    found = bindings.bound_to(every, keys, counts)
    assert broadcasts(found) == 2 and sorted(r.name for r in found.collect()) == sorted([f"r{i}.Order" for i in range(6)] + [f"r{i}.f" for i in (0, 2, 4)])

from functools import reduce
from itertools import combinations_with_replacement

from hypothesis import given
from hypothesis import strategies as st

from credence.functions import identity, lattice
from pyspark.sql import functions as F

JOIN = {frozenset((3, 6)): 6, frozenset((4, 6)): 6, frozenset((3, 4)): 4}


def pair(a, b):
    return a if a == b else JOIN.get(frozenset((a, b)), 7)


@given(st.lists(st.integers(0, 7), min_size=1, max_size=6))
def test_the_pairwise_join_does_not_depend_on_order(ranks):
    assert reduce(pair, ranks) == reduce(pair, reversed(ranks)) == reduce(pair, sorted(ranks))


def test_clash_is_the_pairwise_fold(spark):
    rows = [(i, list(c)) for i, c in enumerate(c for n in (1, 2, 3) for c in combinations_with_replacement(range(8), n))]
    df = spark.createDataFrame(rows, "i int, ranks array<int>").select("i", F.explode("ranks").alias("r"))
    got = {r.i: (r.c, r.m) for r in df.groupBy("i").agg(lattice.provenance_clash(F.col("r")).alias("c"), lattice.least_trusted(F.col("r")).alias("m")).collect()}
    assert got == {i: (reduce(pair, ranks), max(ranks)) for i, ranks in rows}


def test_modulation(spark):
    df = spark.createDataFrame([("CRITICAL", 0), ("ERROR", 2), ("INFO", 4), ("WARN", 3), ("ERROR", 5)], "s string, r int")
    assert [r[0] for r in df.select(lattice.modulate(F.col("s"), F.col("r"))).collect()] == ["CRITICAL", "WARN", "INFO", "INFO", "NONE"]


def test_names_and_fingerprints(spark):
    import hashlib

    df = spark.createDataFrame([("src/a/b.py",), ("src/src/m.py",), ("src/__init__.py",), ("p/__init__.py",), ("x.txt",)], "p string")
    assert [r[0] for r in df.select(identity.module_name(F.col("p"))).collect()] == ["a.b", "src.m", None, "p", None]
    got = spark.range(1).select(identity.fingerprint(F.lit("R"), F.lit("p"), F.lit(None), F.lit("t"))).first()[0]
    assert got == hashlib.sha256(b"R\0p\0\0t").hexdigest()
    wire = spark.createDataFrame([("wlfp2:" + "a" * 64,), ("wlfp1:" + "a" * 64,), ("x",)], "w string")
    assert [r[0] for r in wire.select(identity.from_wire(F.col("w"))).collect()] == ["a" * 64, None, None]

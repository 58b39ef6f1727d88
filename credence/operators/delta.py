"""Delta scans: what an affected scope means in a project, whose files are read again, and what is reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.identity import ancestors, canonical_qualname
from credence.operators.graphs import reachable


def match_scope(scope: DataFrame, entities: DataFrame, seis: DataFrame | None = None) -> DataFrame:
    """``scope`` (locator, sei) with ``qualname``, ``path`` and ``how``: ``sei``, ``locator``, or null where
    nothing matches.  ``seis`` (sei, qualname) is authoritative where its name is known; a name matches an
    entity, or as a class or module any entity below it."""
    known = entities.select(canonical_qualname(F.col("qualname")).alias("qualname"), "path")
    exact = known.select(F.col("qualname").alias("name"), "path", F.lit(0).alias("far"))
    wider = known.select(F.explode(ancestors(F.col("qualname"))).alias("name"), "path", F.lit(1).alias("far"))
    index = exact.unionByName(wider).groupBy("name").agg(F.min(F.struct("far", "path")).alias("at")).select("name", F.col("at.path").alias("path"))
    keyed = scope.select("locator", "sei").distinct()
    text = canonical_qualname(F.col("locator"))
    tries = keyed.filter("locator IS NOT NULL").select("locator", "sei", F.substring_index(text, ":", -1).alias("name"), F.lit(1).alias("prio"), F.lit("locator").alias("how"))
    if seis is not None:
        tries = tries.unionByName(keyed.join(seis.select("sei", F.col("qualname").alias("name")), "sei").select("locator", "sei", "name", F.lit(0).alias("prio"), F.lit("sei").alias("how")))
    found = tries.join(index, "name").groupBy("locator", "sei").agg(F.min(F.struct("prio", "how", "name", "path")).alias("best"))
    found = found.select(F.col("locator").alias("l"), F.col("sei").alias("s"), "best")
    joined = keyed.join(found, F.col("locator").eqNullSafe(F.col("l")) & F.col("sei").eqNullSafe(F.col("s")), "left")
    return joined.select("locator", "sei", F.col("best.name").alias("qualname"), F.col("best.path").alias("path"), F.col("best.how").alias("how"))


def file_edges(facts: DataFrame, seeds: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """(caller, callee) paths: a file and those with a function that one of its calls may mean, by its own name or
    one bound to it (``means``: name, qualname).  Files of one module
    share its names, and hang together by a node of the module's."""
    names = facts.select(F.col("path").alias("caller"), F.explode("references").alias("qualname"))
    if means is not None:
        names = names.unionByName(names.withColumnRenamed("qualname", "name").join(means, "name").select("caller", "qualname"))
    refs = names.join(seeds.select("qualname", F.col("path").alias("callee")).distinct(), "qualname").select("caller", "callee")
    of = facts.select("path", F.explode("entities.module").alias("module")).filter("module IS NOT NULL").distinct().select("path", F.concat(F.lit("\0"), F.col("module")).alias("node"))
    shared = of.select(F.col("path").alias("caller"), F.col("node").alias("callee")).unionByName(of.select(F.col("node").alias("caller"), F.col("path").alias("callee")))
    return refs.unionByName(shared).filter("caller <> callee").distinct()


def files_to_scan(matched: DataFrame, edges: DataFrame, callees: bool = False) -> DataFrame:
    """(path) of the matched files and of all that lead to them along ``edges`` (caller, callee): what their
    functions are given comes from there.  With ``callees``, also of all that those lead to."""
    start = matched.filter("path IS NOT NULL").select(F.col("path").alias("node")).distinct()
    seen = reachable(start, edges)
    if callees:
        seen = reachable(seen, edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")))
    return seen.filter(~F.col("node").startswith("\0")).select(F.col("node").alias("path"))


def module_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(caller, callee) modules of the calls between different modules."""
    of = entities.select("qualname", "module").distinct()
    a = of.select(F.col("qualname").alias("caller"), F.col("module").alias("from"))
    b = of.select(F.col("qualname").alias("callee"), F.col("module").alias("to"))
    return edges.join(a, "caller").join(b, "callee").filter("`from` <> `to`").select(F.col("from").alias("caller"), F.col("to").alias("callee")).distinct()


def delta_report(matched: DataFrame, discovered: DataFrame, analysed: DataFrame, findings: DataFrame) -> DataFrame:
    """One row on how far a delta scan can be trusted: a scope that resolves no file means a full scan, and
    only a full scan's gate is one of record."""
    n = matched.agg(F.count(F.lit(1)).alias("entities_requested"), F.count_if(F.col("how") == "locator").alias("fell_back_count"), F.count_if(F.col("how").isNull()).alias("unresolved_count"), F.count("path").alias("__files"))
    scoped = F.col("__files") > 0
    counts = discovered.agg(F.count(F.lit(1)).alias("files_discovered")), analysed.agg(F.count(F.lit(1)).alias("files_analyzed")), findings.agg(F.count_if((F.col("kind") == "defect") & (F.col("suppression_state") == "active")).alias("in_scope_findings"))
    for c in counts:  # one row each
        n = n.crossJoin(F.broadcast(c))
    return n.select(F.when(scoped, "delta").otherwise("full-fallback").alias("mode"), F.when(scoped, "advisory").otherwise("gate-of-record").alias("gate_authority"), "entities_requested", "files_discovered", "files_analyzed", "in_scope_findings", "fell_back_count", "unresolved_count")

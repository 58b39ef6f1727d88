"""Fixed points and walks on graphs: lattice propagation, reachability, bounded chains."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.functions.lattice import clash

_own: list[str] = []


@atexit.register
def _remove_own() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


def _drop(df: DataFrame) -> None:
    """Delete a table of ``_cut`` that nothing reads any more."""
    path = getattr(df, "_table", None)
    if path:
        jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared checkpoint folder; a folder of our own in local mode."""
    spark: SparkSession = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="credence-rounds-"))
        root = _own[0]
    path = f"{root}/rounds/{uuid.uuid4().hex}"
    # Names that hardly repeat fill most columns: dictionaries of them cost a third of the time and save little.
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt by the join's names, never sent whole to all workers through the driver: what
    is computed, compressed or read in few columns looks small to the planner, however many rows it has."""
    return df.hint("merge")


class Propagated(NamedTuple):
    """``ranks`` (node, rank, via): the fixed point, and for nodes that rose the callee that it came from;
    ``changes`` (node, rank, via) of those alone; ``touched``: how many nodes rose in each round."""

    ranks: DataFrame
    changes: DataFrame
    touched: list[int]


def semi_naive(nodes: DataFrame, edges: DataFrame, clashing: bool = False, rounds: int | None = None) -> Propagated:
    """Least fixed point of rank = own floor joined with what the callees give, by frontiers.

    ``nodes`` (node, rank, anchored, returned): an anchored node keeps its rank and gives ``returned`` to its
    callers.  ``edges`` (caller, callee).  A round computes the callers of nodes that rose in the round before, and
    writes those that rise; nothing else is written.  A caller's callees are folded as the bits of their ranks:
    their weakest, or with ``clashing`` the provenance join.  ``via`` is the weakest callee, ties to the smaller.

    The number of callers of one callee is not bounded, so the frontier meets the edges by callee, and only
    distinct callers go on.  Ranks rise, so the rounds end; ``rounds`` bounds them further.
    """
    fixed = _cut(nodes.select("node", "rank", "anchored", F.coalesce("returned", "rank").cast("int").alias("returned")))
    # An anchored caller is told nothing, and an edge to an unknown callee tells nothing.
    e = _cut(edges.select("caller", "callee").distinct().join(fixed.filter(~F.col("anchored")).select(F.col("node").alias("caller")), "caller", "left_semi").join(fixed.select(F.col("node").alias("callee")), "callee", "left_semi"))
    none = fixed.limit(0).select("node", "rank", F.col("node").alias("via"))
    changes, frontier, touched = none, None, []
    while rounds is None or len(touched) < rounds:
        now = fixed.join(changes.select(F.col("node").alias("__n"), F.col("rank").alias("__r")), F.col("node") == F.col("__n"), "left")
        now = now.select("node", F.coalesce("__r", "rank").alias("rank"), F.when(F.col("anchored"), F.col("returned")).otherwise(F.coalesce("__r", "rank")).alias("given"))
        again = e
        if frontier is not None:
            callers = e.join(frontier.select(F.col("node").alias("callee")), "callee", "left_semi").select("caller").distinct()
            again = e.join(callers, "caller", "left_semi")
        told = again.join(now.select(F.col("node").alias("callee"), "given"), "callee").groupBy(F.col("caller").alias("node"))
        told = told.agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("given"))).alias("mask"), F.max("given").alias("worst"), F.min(F.struct((-F.col("given")).alias("k"), F.col("callee").alias("via"))).alias("first"))
        rank = clash(F.col("mask")) if clashing else F.col("worst")
        told = told.select("node", rank.cast("int").alias("to"), F.col("first.via").alias("via"))
        rose = _cut(told.join(now.select("node", "rank"), "node").filter("`to` > rank").select("node", F.col("to").alias("rank"), "via"))
        count = rose.count()
        if frontier is not None:
            _drop(frontier)
        if not count:
            _drop(rose)
            _drop(e)
            out = fixed.join(changes.select("node", F.col("rank").alias("__r"), "via"), "node", "left").select("node", F.coalesce("__r", "rank").alias("rank"), "via")
            return Propagated(out, changes, touched)
        touched.append(count)
        wider = _cut(changes.join(rose.select("node"), "node", "left_anti").unionByName(rose))
        _drop(changes)
        changes, frontier = wider, rose
    raise RuntimeError("the rank of some node still rises at the bound")


def propagate(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, rank) of the fixed point in which a node is as weak as its weakest callee."""
    return semi_naive(nodes, edges, False, rounds).ranks.select("node", "rank")


def propagate_clash(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """The same under the provenance join: a node's callees are joined, and its rank only rises."""
    return semi_naive(nodes, edges, True, rounds).ranks.select("node", "rank")


def _ends(nexts: DataFrame) -> DataFrame:
    """(node, next): where each chain of ``nexts`` (node, next) leads, by pointer jumping: a chain of n nodes takes
    log2(n) + 1 rounds.  A node in a ring, or that leads into one, keeps a next that is in ``nexts``."""
    now = _cut(nexts)
    for _ in range(math.ceil(math.log2(max(2, now.count()))) + 1):
        hop = now.select(F.col("node").alias("__n"), F.col("next").alias("__to"))
        after = _cut(now.join(hop, F.col("next") == F.col("__n"), "left").select("node", F.coalesce("__to", "next").alias("next"), F.coalesce(F.col("__to") != F.col("next"), F.lit(False)).alias("moved")))
        _drop(now)
        now = after
        if not now.filter("moved").limit(1).count():
            break
    return now


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that lead to ``start`` (node) along ``edges`` (caller, callee), and ``start`` itself.

    A node with a single callee leads where that one leads, so chains are replaced by their ends first; only the nodes
    with several callees are walked round by round, and the chains that end in what was found join them at the end.
    """
    seen = _cut(start.select("node").distinct())
    e = _cut(edges.select("caller", "callee").filter("caller <> callee").distinct().join(seen.select(F.col("node").alias("caller")), "caller", "left_anti"))
    ways = _cut(e.groupBy("caller").agg(F.count(F.lit(1)).alias("n"), F.min("callee").alias("callee")))
    ends = _ends(ways.filter("n = 1").select(F.col("caller").alias("node"), F.col("callee").alias("next")))
    forks = e.join(ways.filter("n > 1").select("caller"), "caller", "left_semi").join(ends.select(F.col("node").alias("callee"), F.col("next").alias("__end")), "callee", "left")
    forks = _cut(forks.select("caller", F.coalesce("__end", "callee").alias("callee")).distinct())
    parts = [seen]
    while parts[-1].limit(1).count():
        step = forks.join(parts[-1].select(F.col("node").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("node")).distinct()
        parts.append(_cut(step.join(reduce(DataFrame.unionByName, parts), "node", "left_anti")))
        if len(parts) > 8:  # what was found before the last round in one table again
            older = _cut(reduce(DataFrame.unionByName, parts[:-1]))
            for p in parts[:-1]:
                _drop(p)
            parts = [older, parts[-1]]
    found = reduce(DataFrame.unionByName, parts)
    out = _cut(found.unionByName(ends.join(found.select(F.col("node").alias("next")), "next", "left_semi").select("node")))
    for t in (e, ways, ends, forks, *parts):
        _drop(t)
    return out


def chain(start: DataFrame, nexts: DataFrame, hops: int = 20) -> DataFrame:
    """(start, depth, node, truncated): follow ``nexts`` (node, next) from ``start`` (node) for at most
    ``hops`` hops; a node that was on the walk before ends it, and truncated marks a walk that could go on."""
    now = start.select(F.col("node").alias("start"), F.col("node"), F.array("node").alias("path"))
    rows = now.select("start", F.lit(0).alias("depth"), "node")
    n = nexts.select(F.col("node").alias("__from"), "next")
    for depth in range(1, hops + 1):
        now = now.join(n, F.col("node") == F.col("__from")).filter(~F.array_contains("path", F.col("next")))
        now = _cut(now.select("start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")))
        if not now.limit(1).count():
            return rows.withColumn("truncated", F.lit(False))
        rows = rows.unionByName(now.select("start", F.lit(depth).alias("depth"), "node"))
    more = now.join(n, F.col("node") == F.col("__from")).filter(~F.array_contains("path", F.col("next"))).select(F.col("start").alias("__s")).distinct()
    return rows.join(more, F.col("start") == F.col("__s"), "left").withColumn("truncated", F.col("__s").isNotNull()).drop("__s")


def strongly_connected(edges: DataFrame, most: int = 2_000_000) -> list[list]:
    """Strongly connected components, callees first; for metrics only, and only up to ``most`` edges,
    because it runs on the driver."""
    rows = edges.select("caller", "callee").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges")
    graph: dict = {}
    for r in rows:
        graph.setdefault(r.caller, set()).add(r.callee)
        graph.setdefault(r.callee, set())
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in sorted(graph):
        if root in index:
            continue
        work = [(root, iter(sorted(graph[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(sorted(graph[w]))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    out.append(sorted(part))
    return out


def resolve_calls(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(call_id, callee): of a call's candidate names (call_id, prio, fqn), the first that is known."""
    found = candidates.join(known.select(F.col("qualname").alias("fqn")).distinct(), "fqn", "left_semi")
    return found.groupBy("call_id").agg(F.min(F.struct("prio", "fqn")).alias("__best")).select("call_id", F.col("__best.fqn").alias("callee"))


def first_by_priority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Precedence lookup: per key the value with the least ``prio``, ties to the smaller value."""
    return rows.groupBy(*keys).agg(F.min(F.struct("prio", value)).alias("__best")).select(*keys, F.col(f"__best.{value}").alias(value))


def enclosing_tier(entities: DataFrame, declared: DataFrame) -> DataFrame:
    """(qualname, rank): the rank of the innermost declared scope around a name, else its own."""
    parts = F.split("qualname", r"\.<locals>\.")
    scopes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ".<locals>."))
    tried = entities.select("qualname", "rank", F.posexplode(scopes).alias("depth", "scope"))
    d = declared.select(F.col("qualname").alias("scope"), F.col("rank").alias("of"))
    found = tried.join(d, "scope").groupBy("qualname").agg(F.max(F.struct("depth", "of")).alias("near")).select(F.col("qualname").alias("q"), F.col("near.of").alias("of"))
    return entities.join(found, F.col("qualname") == F.col("q"), "left").select("qualname", F.coalesce("of", "rank").alias("rank"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key, the last row in ``order`` (later bindings replace earlier ones)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")

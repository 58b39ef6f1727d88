"""Lenses on a scan: where a finding's taint comes from, what a boundary's posture is, and fixes."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.lattice import state_name
from credence.operators import findings as fo
from credence.operators.graphs import chain


def explain(findings: DataFrame, functions: DataFrame, hops: int = 20) -> DataFrame:
    """Per finding: the declared and actual tiers, the callee that brings the taint, and the walk to its
    source (at most ``hops`` steps, with a guard against cycles)."""
    f = functions.select("qualname", state_name(F.col("ret")).alias("declared"), state_name(F.col("actual")).alias("actual"), "ret_callee")
    out = findings.join(f, "qualname", "left")
    nexts = functions.filter("ret_callee IS NOT NULL").select(F.col("qualname").alias("node"), F.col("ret_callee").alias("next")).distinct()
    start = out.filter("ret_callee IS NOT NULL").select(F.col("qualname").alias("node")).distinct()
    walks = chain(start, nexts, hops)
    flow = walks.groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda s: s["node"]).alias("walk"), F.max("truncated").alias("truncated"))
    return out.join(flow, F.col("qualname") == F.col("start"), "left").select("fingerprint", "rule_id", "qualname", "declared", "actual", F.col("ret_callee").alias("immediate_callee"), F.reverse("walk").alias("code_flow"), "truncated")


def declared_entities(functions: DataFrame) -> DataFrame:
    """The trust surface: what declares a boundary, with its declared and actual ranks."""
    return functions.filter("source IN ('anchored', 'config')").select("qualname", "path", "line_start", F.col("ret").alias("declared_rank"), F.col("actual").alias("actual_rank"))


def assurance_of(result: dict[str, DataFrame], unanalyzed: int) -> DataFrame:
    return fo.assurance(fo.entity_trust(declared_entities(result["functions"]), result["findings"]), unanalyzed)


def coverage_of(result: dict[str, DataFrame]) -> DataFrame:
    return fo.decorator_coverage(fo.entity_trust(declared_entities(result["functions"]), result["findings"]), result["findings"])


def attestation(result: dict[str, DataFrame]) -> DataFrame:
    """The rows that an attestation signs: every boundary and its verdict, in order."""
    return fo.entity_trust(declared_entities(result["functions"]), result["findings"]).select("qualname", state_name(F.col("declared_rank")).alias("declared"), state_name(F.col("actual_rank")).alias("actual"), "verdict").orderBy("qualname")


def excerpt(source, line, context: int = 2, most: int = 2000):
    """Lines around ``line`` of a source column, cut to ``most`` characters."""
    lines = F.split(source, "\n")
    first = F.greatest(line - context, F.lit(1))
    return F.substring(F.array_join(F.slice(lines, first, F.least(F.lit(2 * context + 1), F.size(lines))), "\n"), 1, most)


def replace_asserts(source: str, functions: set[str]) -> str:
    """Rewrite the asserts of the named functions into checks that survive optimised runs."""
    tree = ast.parse(source)
    lines = source.split("\n")
    edits = []

    def walk(node: ast.AST, prefix: str, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = prefix + child.name
                walk(child, f"{name}.<locals>.", name in functions)
            elif isinstance(child, ast.ClassDef):
                walk(child, f"{prefix}{child.name}.", False)
            else:
                if inside and isinstance(child, ast.Assert):
                    edits.append(child)
                walk(child, prefix, inside)

    walk(tree, "", False)
    for node in sorted(edits, key=lambda n: -n.lineno):
        own = lines[node.lineno - 1]
        if own[: node.col_offset].strip():
            continue  # not alone on its line
        pad = own[: node.col_offset]
        message = ast.unparse(node.msg) if node.msg else repr(f"check failed: {ast.unparse(node.test)}")
        lines[node.lineno - 1 : node.end_lineno] = [f"{pad}if not ({ast.unparse(node.test)}):", f"{pad}    raise ValueError({message})"]
    return "\n".join(lines)

"""Operator 13: a Merkle manifest of a dataset, built and proved by iterative DataFrame levels.

Every row is a leaf, the sha256 of its fields.  In each group the leaves are numbered by row_number; a node's
parent is its number divided by the fan-out, and a parent hashes its children's digests, gathered as a sorted
array.  The nodes that are left, one a group, are the leaves of one more tree, whose top is the root.

A group may hold any share of the rows.  Numbers are found in ranges of the order (one range partitioning, a
row_number in each range and a shift by the ranges before), so no task sees a whole group.  Each level is a table
of 1/fan-out of the rows of the one below it.  Proofs go down the same tables: a child's proof is its siblings
followed by its parent's proof, so that what a run of children shares above is joined once for all of them.

Digests are lowercase hex and are hashed as text.

Defined cases: a null field is ``-``, so it differs from an empty one; null and empty group are two groups, the
null one first; rows with null ids come first, in the order of their leaves, and so do rows with equal ids; equal rows have
equal leaves and places of their own; a lone leaf is its group's top, and one row in all is the root, with an
empty proof; an empty table gives an empty one; texts are hashed whole; other columns are neither read nor changed.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.llm.common import materialize, release, table

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` if null, else its count of UTF-8 bytes, ``:`` and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(value: Column) -> Column:
    """Groups as text that is never null and sorts bytewise with the null group first."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def numbered(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """Add ``i``, the place of each row in its group ``g`` from 0 without gaps, and ``n``, the group's size.

    ``rows`` is a table, so that the tie column below is the same whenever a lost task runs again.
    """
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["g", *order, "tie"]
    cells = materialize(tied.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).withColumn("cell", F.spark_partition_id()), tag)
    # One row for each range and group: as many as there are partitions, and groups.
    counts = cells.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("g").alias("sg"), F.col("cell").alias("sc"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"), F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    inside = Window.partitionBy("g", "cell").orderBy(*[F.col(c).asc_nulls_first() for c in keys[1:]])
    at = cells.withColumn("at", F.row_number().over(inside) - 1)
    out = at.join(shifts, (F.col("g") == F.col("sg")) & (F.col("cell") == F.col("sc")))
    out = materialize(out.select(*rows.columns, (F.col("at") + F.col("shift")).cast("long").alias("i"), F.col("n").cast("long").alias("n")), tag)
    release(cells)
    return out


class Tree(NamedTuple):
    """Trees of all groups, by level: ``nodes`` numbers the lowest, ``runs[k]`` (g, p, n, kids) holds the
    runs of level k, n the number of nodes of the group there; ``tops`` (g, h) are what remains of each."""

    nodes: DataFrame
    runs: list[DataFrame]
    fanout: int

    @property
    def tops(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.ends(k).select("g", "h") for k in range(len(self.runs) + 1)])

    def level(self, k: int) -> DataFrame:
        """(g, i, n, h) of the nodes at level ``k``."""
        if k == 0:
            return self.nodes.select("g", "i", "n", "h")
        size = F.floor((F.col("n") + self.fanout - 1) / self.fanout).cast("long")
        return self.runs[k - 1].select("g", F.col("p").alias("i"), size.alias("n"), F.sha2(F.array_join(F.col("kids.h"), ""), 256).alias("h"))

    def ends(self, k: int) -> DataFrame:
        """The groups that have one node left at level ``k``, and had more below."""
        return self.level(k).filter("n = 1")

    def drop(self) -> None:
        for df in (self.nodes, *self.runs):
            release(df)


def tree(nodes: DataFrame, carried: list[str], fanout: int, tag: str) -> Tree:
    """The levels over ``nodes`` (g, i, n, h, *carried); runs of the lowest level keep the carried columns."""
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    out = Tree(nodes, [], fanout)
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        k = len(out.runs)
        own = nodes if k == 0 else out.level(k)
        kid = F.struct("i", "h", *(carried if k == 0 else []))
        runs = own.filter("n > 1").groupBy("g", F.expr(f"i div {fanout}").alias("p"), "n").agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        out.runs.append(materialize(runs, f"{tag}-level"))
        most = -(-most // fanout)
    return out


PATH = "array<struct<l:string,r:string>>"


def descend(built: Tree, tops: DataFrame, carried: list[str]) -> DataFrame:
    """(g, i, h, *carried, top, path) of every lowest node, from ``tops`` (g, top, path): path holds at
    each level the digests left and right of the node in its run, its own level first."""
    last = len(built.runs)
    start = lambda k: built.ends(k).select("g", "i").join(tops, "g")
    now = start(last)
    for k in range(last - 1, -1, -1):
        met = built.runs[k].join(now.withColumnRenamed("i", "p"), ["g", "p"])
        side = lambda kids, a, b: F.array_join(F.transform(F.slice(kids, a, b), lambda x: x["h"]), "")
        sides = F.transform("kids", lambda kid, at: F.struct(kid.alias("kid"), F.struct(side(F.col("kids"), F.lit(1), at).alias("l"), side(F.col("kids"), at + 2, F.lit(built.fanout)).alias("r")).alias("step")))
        each = met.select("g", "top", "path", F.explode(sides).alias("e"))
        now = each.select("g", F.col("e.kid.i").alias("i"), *([F.col("e.kid.h").alias("h"), *[F.col(f"e.kid.{c}").alias(c) for c in carried]] if k == 0 else []), "top", F.concat(F.array("e.step"), "path").alias("path"))
        if k:
            now = now.unionByName(start(k))
    lone = built.nodes.filter("n = 1").select("g", "i", "h", *carried).join(tops, "g")
    return lone.unionByName(now) if last else lone


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["l"], h, step["r"]), 256))


def path_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["l"], step["r"])), ""), 256)


def manifest(leaves: DataFrame, carried: list[str], order: list[str], fanout: int = FANOUT) -> DataFrame:
    """(carried columns, h, i, top, root, path) of every leaf of ``leaves`` (g, h, *order, *carried): the leaf's
    digest and number in its group, the group's top, the root, and the siblings on the way to it."""
    spark = leaves.sparkSession
    rows = materialize(leaves, "merkle-leaves")
    nodes = numbered(rows, order, "merkle-nodes")
    release(rows)
    built = tree(nodes, carried, fanout, "merkle")
    subroots = materialize(built.tops, "merkle-tops")
    named = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "h"), ["of"], "merkle-groups")
    above = tree(named, ["of"], fanout, "merkle-top")
    root = above.tops.first()  # one row
    start = spark.range(1 if root else 0).select(F.lit("").alias("g"), F.lit(root["h"] if root else None).cast("string").alias("top"), F.array().cast(PATH).alias("path"))
    tops = materialize(descend(above, start, ["of"]).select(F.col("of").alias("g"), F.col("h").alias("top"), "path"), "merkle-proofs")
    for t in (subroots, *above.runs, named):
        release(t)
    return descend(built, tops, carried).withColumn("root", F.lit(root["h"] if root else None).cast("string"))


def verify(kept: DataFrame, docs: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, verified): whether the rows of ``docs`` lead to the root by the paths that ``kept`` (key, path, root)
    holds for them; rows without a path don't.  ``key`` is unique in both."""
    now = docs.select(key, leaf_digest(*map(F.col, fields)).alias("__leaf"))
    met = now.join(kept.select(F.col(key).alias("__key"), "path", "root"), F.col(key) == F.col("__key"), "left")
    return met.select(key, F.coalesce(fold(F.col("__leaf"), F.col("path")) == F.col("root"), F.lit(False)).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = [F.translate(F.col(c), UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    leaves = docs.select(group_key(F.col("lang")).alias("g"), "doc_id", leaf_digest(*map(F.col, FIELDS)).alias("h"), F.when(picked, leaf_digest(*lowered)).alias("tampered"))
    rows = manifest(leaves, ["doc_id", "tampered"], ["doc_id", "h"])
    folded = fold(F.coalesce("tampered", "h"), F.col("path"))
    out = rows.select("doc_id", F.col("h").alias("leaf"), F.col("top").alias("subroot"), "root", path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 10, top_levels: int = 5) -> str:
    """DuckDB SQL of the query, for groups of up to FANOUT ** levels rows and FANOUT ** top_levels groups."""
    f = FANOUT
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in FIELDS) + ")"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"

    def levels_of(name: str, lowest: str, count: int) -> str:
        out = [f"{name}0 AS ({lowest})"]
        for k in range(count):
            sides = [f"coalesce(string_agg(h, '') OVER (PARTITION BY g, i // {f} ORDER BY i ROWS BETWEEN {span}), '') AS {side}" for side, span in (("l", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("r", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))]
            out.append(f"{name}s{k} AS (SELECT g, i, n, {', '.join(sides)} FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT g, i // {f} AS i, (n + {f - 1}) // {f} AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}{k} GROUP BY g, i // {f}, n)")
        return ",\n".join(out)

    def walk(name: str, count: int, source: str, keep: str) -> str:
        out = []
        for k in range(count):
            out.append(f"{name}w{k + 1} AS (SELECT w.* EXCLUDE (proof, folded, spot), w.spot // {f} AS spot, CASE WHEN s.n > 1 THEN proof || l || r ELSE proof END AS proof, CASE WHEN s.n > 1 THEN sha256(l || folded || r) ELSE folded END AS folded FROM {source if k == 0 else f'{name}w{k}'} w JOIN {name}s{k} s ON s.g = {keep} AND s.i = w.spot)")
        return ",\n".join(out)

    return f"""
WITH tab AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_concat([b::UBIGINT], range(8)::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(b))),
crc AS (SELECT doc_id AS of_id, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)), lambda c, x: xor(c >> 8, tab.t[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tab),
base AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {leaf('text')} AS h, CASE WHEN crc.crc % 3 = 0 THEN {leaf(lowered)} END AS tampered
  FROM documents LEFT JOIN crc ON of_id = doc_id),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM base),
{levels_of('a', 'SELECT g, i, n, h FROM placed', levels)},
{levels_of('b', f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS of FROM a{levels}", top_levels)},
start AS (SELECT placed.*, i AS spot, '' AS proof, coalesce(tampered, h) AS folded FROM placed),
{walk('a', levels, 'start', 'w.g')},
turn AS (SELECT w.* REPLACE (b0.i AS spot), b0.h AS subroot FROM aw{levels} w JOIN b0 ON b0.of = w.g),
{walk('b', top_levels, 'turn', "''")}
SELECT doc_id, w.h AS leaf, subroot, b{top_levels}.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b{top_levels}.h AS verified FROM bw{top_levels} w, b{top_levels}
"""


ORACLE = oracle()

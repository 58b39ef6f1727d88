"""Operator 6: sharding by weighted rendezvous hashing, in native expressions.

The key of a record and a shard's number give a uniform draw u; the record goes to the shard with the
largest weight / -ln(u).  One more shard competes only with the winner so far, so records move into the
new shard or stay.  A row's slot is its rank in its shard by the md5 of the key: the rank is found in
ranges of the md5, so that a shard of any size is numbered by many tasks.

The law that holds is ``key``: the id and the shard count alone decide.  Equal texts may part.

Defined cases: a null text has no bytes (size 16, crc32 0); a null id is the empty key; rows with equal
ids share a shard and have slots of their own; an empty table gives an empty table; other columns pass, and one named like a column that is added is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.common import dense_index, fresh, refuse_clash, table

SHARDS = 40
#: Hex digits of the md5 that make the draw: 52 bits, exact in a double.
DRAW_DIGITS = 13
ROW_OVERHEAD = 16


def _cost(key: str, shard: str, weights: list[float]) -> str:
    """SQL for -ln(u) / weight, least for the winner; ``key`` and ``shard`` are SQL expressions."""
    draw = f"(cast(conv(substring(md5(concat({key}, ':', cast({shard} as string))), 1, {DRAW_DIGITS}), 16, 10) as double) + 0.5D) / {float(16**DRAW_DIGITS)!r}D"
    if len(set(weights)) == 1:
        return f"-ln({draw})"
    return f"-ln({draw}) / element_at(array({', '.join(f'{float(w)!r}D' for w in weights)}), {shard} + 1)"


def assign(df: DataFrame, key: str, shards: int, weights: list[float] | None = None, shard: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Add ``shard`` for ``shards`` shards and, if named, ``grown`` for one shard more."""
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("weights: one positive number for each shard")
    all_weights = [*weights, grown_weight]
    refuse_clash(df, {shard, grown} - {None})
    own, won = fresh("__key", df.columns), fresh("__best", df.columns)
    text_key = F.coalesce(F.col(key).cast("string"), F.lit(""))
    best = f"array_min(transform(sequence(0, {shards - 1}), s -> named_struct('cost', {_cost(own, 's', all_weights)}, 's', s)))"
    out = df.withColumn(own, text_key).withColumn(won, F.expr(best)).withColumn(shard, F.col(f"{won}.s").cast("int"))
    if grown:
        out = out.withColumn(grown, F.expr(f"case when {_cost(own, str(shards), all_weights)} < {won}.cost then {shards} else {shard} end").cast("int"))
    return out.drop(own, won)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = assign(rows, "doc_id", SHARDS, grown="grown_shard").withColumn("key_md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    out = dense_index(rows, ["shard"], "key_md5", ["doc_id", "size", "text_crc32"], "slot", docs.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: DuckDB has no crc32, so the SQL folds the bytes of the text through the table of the polynomial.
ORACLE = f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_concat([b::UBIGINT], range(8)::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(b))),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(cast(doc_id AS VARCHAR), '') AS k FROM documents),
bytes AS (SELECT t, list_transform(range(0, octet_length(encode(t))), lambda i: ('0x' || hex(encode(t))[2 * i + 1 : 2 * i + 2])::UBIGINT) AS b FROM (SELECT DISTINCT t FROM d)),
crc AS (SELECT bytes.t, xor(list_reduce(list_concat([4294967295::UBIGINT], b), lambda c, x: xor(c >> 8, tab.t[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM bytes, tab),
draws AS (SELECT doc_id, t, k, s, -ln((('0x' || md5(k || ':' || s)[1:{DRAW_DIGITS}])::BIGINT::DOUBLE + 0.5) / {float(16**DRAW_DIGITS)!r}) AS cost FROM d, range({SHARDS + 1}) r(s)),
won AS (SELECT doc_id, t, k, arg_min(s, cost) FILTER (s < {SHARDS}) AS shard, arg_min(s, cost) AS grown_shard FROM draws GROUP BY ALL)
SELECT doc_id, (octet_length(encode(won.t)) + {ROW_OVERHEAD})::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id) - 1 AS slot, grown_shard::INT AS grown_shard
FROM won JOIN crc ON crc.t = won.t
"""

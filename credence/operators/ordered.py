"""Operators on an order over all rows: numbers, running sums, cuts at a budget and digests, without a task that sees
all rows.  Rows are dealt by ranges of the order; what the ranges before a range add up to is added to each."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.operators.graphs import _cut, _drop

#: Digests that are hashed into one.
FANOUT = 512


def running(rows: DataFrame, order: list[Column], amount: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows up to this one in ``order``; nulls add nothing.  Rows that tie
    in ``order`` come in one of their orders.  ``rows`` is read twice and must be the same each time."""
    keys = [f"__k{i}" for i in range(len(order))]
    keyed = rows.select("*", *[c.alias(k) for c, k in zip(order, keys)], F.coalesce(amount, F.lit(0)).alias("__amount"))
    cells = _cut(keyed.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("__cell", F.spark_partition_id()))
    # One row for each range: as many as there are partitions.
    totals = sorted((r["__cell"], r["total"]) for r in cells.groupBy("__cell").agg(F.sum("__amount").alias("total")).collect())
    kind = dict(cells.agg(F.sum("__amount").alias("x")).dtypes)["x"]
    starts = [(cell, start) for (cell, _), start in zip(totals, accumulate((t for _, t in totals), initial=0))]
    shifts = rows.sparkSession.createDataFrame(starts, f"__at int, __start {kind}")
    inside = Window.partitionBy("__cell").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cells.withColumn("__sum", F.sum("__amount").over(inside)).join(F.broadcast(shifts), F.col("__cell") == F.col("__at"))
    return summed.select(*rows.columns, (F.col("__sum") + F.col("__start")).alias(out))


def within_budget(rows: DataFrame, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The first rows in ``order`` whose costs add up to ``budget`` at most, with ``spent``, the sum so far.  Costs
    are not negative, so what is left out is a tail."""
    return running(rows, order, cost, "spent").filter(F.col("spent") <= budget)


def numbered(rows: DataFrame, order: list[Column], out: str = "number") -> DataFrame:
    """Number the rows in ``order`` from 0."""
    return running(rows, order, F.lit(1).cast("long"), out).withColumn(out, F.col(out) - 1)


def row_digest(columns: list[str]) -> Column:
    """A digest of a row: its columns by name, as JSON with nulls."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def digest(leaves: DataFrame) -> tuple[int, str]:
    """(rows, digest) of ``leaves`` (number, digest): each FANOUT neighbours are hashed into one, until one is left.
    The digest of no rows is that of an empty text."""
    now = leaves.select("number", "digest")
    n = size = leaves.count()
    while n > 1:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "digest"))), lambda s: s["digest"]), "")
        after = _cut(now.groupBy(F.expr(f"number div {FANOUT}").alias("number")).agg(F.sha2(text, 256).alias("digest")))
        _drop(now)
        now, n = after, -(-n // FANOUT)
    last = now.first() if size else None
    return size, last["digest"] if last else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

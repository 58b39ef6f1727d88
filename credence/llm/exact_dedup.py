"""Operator 9: exact dedup by distributed MSD radix partitioning.

Texts are equal when they are identical after white space is deleted.  A round takes the next digit (some
bytes, four times as many as the round before) of every open document, splits each group by it, and sets
aside groups of one row and groups whose text ends here: those are equal byte for byte, and no digest
takes part in the decision.  The first digit is read off the text's beginning, so only documents that share
it with another are normalised to be moved, once; each later round carries what is left behind the last
digit.  A group of copies of any size is counted before the shuffle, and the join that hands rows their
group can be split where one group is large.

Defined cases: null counts as empty, and all empty texts are one group; equal rows stay separate rows, of
which one is kept; a null doc_id comes after every other; very long texts go on for more rounds; an empty
table gives an empty result; ``drop_copies`` passes all columns through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import SPACES, bitmap_filter, materialize, passes_filter, release, table, with_row_numbers, without_rows, worker_state

#: Bytes of the first digit; each later digit has GROWTH times as many.
FIRST_DIGIT, GROWTH = 48, 4
#: Characters from whose normal form the first digit is read, if they hold enough.
LOOK = 128
BATCH_ROWS = 256


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _first_digit(text: Column) -> tuple[Column, Column]:
    """(the first FIRST_DIGIT bytes of the normal form, whether there are more)."""
    start = normalised(F.substring(text, 1, LOOK)).cast("binary")
    whole = F.when((F.octet_length(start) > FIRST_DIGIT) | (F.char_length(text) <= LOOK), start).otherwise(normalised(text).cast("binary"))
    return F.substring(whole, 1, FIRST_DIGIT), F.octet_length(whole) > FIRST_DIGIT


def _normal_forms(batches: Iterator) -> Iterator:
    """The text's place (the last column) is taken by the digest of its normal form and, where the row may
    go on, the bytes behind the first digit."""
    import pyarrow as pa

    worker_state("exact_dedup")
    white = SPACES.encode()
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            may = part.column(part.schema.get_field_index("may")).to_pylist()
            sha, rest = [], []
            for moves, text in zip(may, part.column(part.num_columns - 1)):
                whole = (text.as_py() or b"").translate(None, white)
                sha.append(hashlib.sha256(whole).digest())
                rest.append(whole[FIRST_DIGIT:] if moves else None)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sha, pa.binary()), pa.array(rest, pa.binary())], names=[*part.schema.names[:-1], "sha", "rest"])


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """id, keep_id, size, kept and sha of each document, and ``row``, a unique number, if one is named."""
    words = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), *([F.col(row).alias("row")] if row else []), F.lit(0).cast("long").alias("gid"), F.char_length(words).alias("points"), words.alias("text"))
    digit, more = _first_digit(F.col("text"))
    keyed = keyed.withColumn("digit", digit).withColumn("more", more)
    own = ["id", "row"] if row else ["id"]
    start, width, done = 0, FIRST_DIGIT, []
    while True:
        best = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("void"), F.col("id").alias("id")))
        groups = keyed.groupBy("gid", "digit", "more").agg(F.count(F.lit(1)).alias("size"), best.alias("best")).filter("size > 1")
        groups = materialize(groups.withColumn("next", F.monotonically_increasing_id()), f"radix-groups-{start}")
        single = None
        if not start:
            # Rows whose first digit is their own need not move: a bitmap of the digits that occur twice
            # lets every other row through, and equality is still decided on the bytes.
            key = F.xxhash64("digit", "more")
            bitmap, n_bits = bitmap_filter(groups.select(key.alias("h")), "h")
            tried = passes_filter(keyed, key, bitmap, n_bits, "may").select(*own, "gid", "points", "digit", "more", "may", F.col("text").cast("binary").alias("text"))
            fields = [f for f in tried.schema.fields if f.name != "text"]
            kinds = T.StructType([*fields, T.StructField("sha", T.BinaryType()), T.StructField("rest", T.BinaryType())])
            forms = materialize(tried.mapInArrow(_normal_forms, kinds), "radix-forms")
            keyed = forms.filter("may").drop("may")
            single = forms.filter("NOT may").select(*own, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "sha")
        right = groups.select(F.col("gid").alias("g"), F.col("digit").alias("d"), F.col("more").alias("m"), "size", "best", "next").hint("merge")
        joined = keyed.join(right, (F.col("gid") == F.col("g")) & (F.col("digit") == F.col("d")) & (F.col("more") == F.col("m")), "left")
        goes_on = F.col("more") & F.col("size").isNotNull()
        first = F.col("size").isNull() | ((-F.col("points") == F.col("best.less")) & F.col("id").eqNullSafe(F.col("best.id")))
        split = materialize(
            joined.select(
                *own, "points", "sha",
                F.when(goes_on, F.col("rest")).alias("rest"),
                goes_on.alias("goes_on"),
                F.col("next").alias("gid"),
                F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
                F.coalesce("size", F.lit(1)).cast("long").alias("size"),
                first.alias("first"),
                F.monotonically_increasing_id().alias("rid"),
            ),
            f"radix-rows-{start}",
        )
        release(groups)
        ended = split.filter(~F.col("goes_on"))
        # Rows equal in id and text are all "first": the one with the lowest number is kept.
        ties = ended.filter("first and size > 1").groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("lowest")).filter("n > 1")
        if ties.limit(1).count():
            low = ties.select(F.col("gid").alias("tied"), "lowest")
            ended = ended.join(low, F.col("gid") == F.col("tied"), "left").withColumn("first", F.col("first") & (F.col("lowest").isNull() | (F.col("rid") == F.col("lowest"))))
        done.append(ended.select(*own, "keep_id", "size", F.col("first").alias("kept"), "sha"))
        if single is not None:
            done.append(single)
        going = split.filter("goes_on")
        if not going.limit(1).count():
            break
        start, width = start + width, width * GROWTH
        keyed = going.select(*own, "gid", "points", "sha", F.substring("rest", 1, width).alias("digit"), (F.octet_length("rest") > width).alias("more"), F.substring("rest", width + 1, 2**31 - 1 - width).alias("rest"))
    return reduce(DataFrame.unionByName, done).withColumn("sha", F.lower(F.hex("sha")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text equals a kept row's.  Only the rows that go are looked up."""
    numbered, number = with_row_numbers(docs, id_col)
    found = radix_groups(numbered.select(F.col(id_col).alias("id"), F.col(number).alias("number"), F.col(text).alias("text")), "id", "text", "number")
    gone = materialize(found.filter("NOT kept").select("row"), "copies")
    return without_rows(numbered, number, gone).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = radix_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
r AS (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS group_size,
        first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k
      FROM d WINDOW w AS (PARTITION BY s ORDER BY length(t) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(s) AS text_sha256 FROM r
"""

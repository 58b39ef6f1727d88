"""The corpus pipeline: stages over the documents table, each written as Parquet and read again.

Every stage but the last returns the columns of documents.  A stage begins by dropping the scratch tables
of the stage before it, whose result has been written by then; other tables stay.  The driver gives the memory of
earlier queries back before a stage and before its result is written: it runs hundreds, and their plans add up.

Defined cases, for the stages and for ``run``: an empty table gives an empty result, and so does a table
without labelled rows, since nothing is learned from it; a null text is no language and goes in the first
stage; rows with equal or null ids are separate documents; further columns pass every stage.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import byte_bpe, exact_dedup, language_id, mixing, ngram_join
from credence.llm.common import fresh, give_back_driver, live, release_paths, remove, scratch_root, table

#: The scratch tables of the last stage.
_last: set[str] = set()


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_paths(_last)
        _last.clear()
        give_back_driver(spark)
        there = live()
        out = work(spark, docs, sf_dir)
        _last.update(live() - there)
        give_back_driver(spark)  # of the queries that it has run; those of the result follow
        return out

    return stage


@_stage
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or with a score below the calibrated bound, go."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    names = [fresh(c, docs.columns) for c in ("__lang", "__score", "__rejected")]
    return language_id.predict(docs, model, "text", *names).filter(~F.col(names[-1])).select(*docs.columns)


@_stage
def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of texts equal but for white space, the longest stays."""
    return exact_dedup.drop_copies(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents, the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: all documents, in the order of the schedule; files and rows follow it."""
    own = {c: fresh(f"__own_{c}", docs.columns) for c in docs.columns if c.lower() in ("block", "slot", "position")}
    mixed = mixing.mix(docs.withColumnsRenamed(own)).orderBy("position").drop("block", "slot", "position")
    return mixed.withColumnsRenamed({new: old for old, new in own.items()}).select(*docs.columns)


def written_order(docs: DataFrame, out: str = "position") -> DataFrame:
    """Add each row's place, from 0 without gaps, in the order that a stage wrote: by number of the part
    file, then by row in it.  Readers take the files in an order of their own, so the names tell it."""
    file, row, name, start = (fresh(c, docs.columns) for c in ("__file", "__row", "__name", "__start"))
    rows = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    # One row for each file.
    sizes = {r[file]: r["n"] for r in rows.groupBy(file).agg((F.max(row) + 1).alias("n")).collect()}
    starts, at = [], 0
    for f in sorted(sizes, key=lambda f: (int(f.split("-")[1]), f)):
        starts.append((f, at))
        at += sizes[f]
    plan = docs.sparkSession.createDataFrame(starts, f"{name} string, {start} long")
    return rows.join(F.broadcast(plan), F.col(file) == F.col(name)).select(*docs.columns, (F.col(start) + F.col(row)).alias(out))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token counts and digests of every document that is left, with its ``position`` in
    the order that the stage before wrote, which is the schedule.  Columns that exist already under one of
    these names come out with underscores in front."""
    added = ("position", "n_tokens", "ids_sha256", "decoded_sha256")
    own = {c: fresh(f"_{c}", docs.columns) for c in docs.columns if c.lower() in added}
    place = fresh("__place", docs.columns)
    rows = written_order(docs, place).withColumnsRenamed(own)
    out = byte_bpe.round_trip(rows).withColumnRenamed(place, "position")
    return out.select(*[own.get(c, c) for c in docs.columns if c != "text"], *added)


STAGES = [
    ("language_id", languages),
    ("exact_dedup", copies),
    ("near_duplicates", near_copies),
    ("source_mixing", mixture),
    ("byte_bpe", tokens),
]

#: No SQL states a trained model or a tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_root(spark)}/credence-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    release_paths(_last)
    _last.clear()
    return docs

"""Scanning changed files as a stream: an extension of our own, with the latest version of a file winning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credence.plans.scan import finish, scan


def newest(files: DataFrame) -> DataFrame:
    """Of each path in a batch (path, source, version), the newest version."""
    w = Window.partitionBy("path").orderBy(F.desc("version"))
    return files.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k", "version")


def rescan(files: DataFrame, checkpoint: str, deliver: Callable[[DataFrame, int], None], **options) -> StreamingQuery:
    """Scan each micro-batch of (path, source, version) as one project and hand its findings on; ``deliver`` reads
    them before it returns, for then the tables of the scan go."""

    def batch(df: DataFrame, epoch: int) -> None:
        out = scan(newest(df), **options)
        deliver(out["findings"], epoch)
        finish(out)

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()

"""Operator 5: mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks.  The j-th block of a source with weight w (weights sum to 1) is
released at slot floor((j - 1) / w) and due at slot ceil(j / w); in each slot the released block with the
earliest deadline runs.  On one processor this keeps every source within less than one block of its share
at every slot.  When a source runs out, the others' weights are scaled up and a new phase begins, so every
row is scheduled exactly once.

The schedule depends on the sources' sizes alone: it has at most MAX_BLOCKS blocks and one more for each
source, so it is computed on the driver and broadcast.  Rows are numbered inside their source by ranges of
a hash, so a source with a third of all rows is numbered by many tasks.

Defined cases: a null source is a source of its own; sources without a weight, or with weight 0, come
after all others; rows with equal ids keep places of their own; an empty table gives an empty schedule;
more than MAX_SOURCES sources are an error, and so is a column named block, slot or position.  A block has
``block_rows`` rows, or more where the table would need more than MAX_BLOCKS of them: the deviation is less
than one block of ``ceil(rows / MAX_BLOCKS)`` rows then.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.common import dense_index, fresh, refuse_clash, table

MAX_BLOCKS = 1 << 16
MAX_SOURCES = 10_000
#: Weights are integers out of this.
WEIGHT_SCALE = 1_000_000


def phase(weights: Mapping[str, int], blocks: dict[str, int]):
    """Slots of one phase, until a source runs out: yields names, and takes the blocks from ``blocks``."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    release = lambda s, j: j * total // weights[s]  # noqa: E731  of the block after j blocks
    due = lambda s, j: -(-(j + 1) * total // weights[s])
    waiting = [(0, s) for s in sorted(weights)]
    ready: list[tuple[int, str]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, done[s]), s))
        _, s = heapq.heappop(ready)
        done[s] += 1
        blocks[s] -= 1
        slot += 1
        yield s
        if not blocks[s]:
            return
        heapq.heappush(waiting, (release(s, done[s]), s))


def schedule(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[str]:
    """The source of each slot; every block of every source has one slot."""
    left = {s: n for s, n in blocks.items() if n > 0}
    out: list[str] = []
    while left:
        live = {s: weights.get(s, 0) for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1)
        out.extend(phase(live, left))
        left = {s: n for s, n in left.items() if n}
    return out


def tempered(counts: Mapping[str, int], power: float = 0.5) -> dict[str, int]:
    """Target weights in proportion to size ** power."""
    sizes = {s: n**power for s, n in counts.items()}
    total = sum(sizes.values())
    return {s: max(1, round(WEIGHT_SCALE * x / total)) for s, x in sizes.items()}


def mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id", weights: Mapping[str | None, float] | None = None, block_rows: int | None = None) -> DataFrame:
    """Add ``block`` (in the source), ``slot`` and ``position`` (both from 0, gapless) to each row.

    ``weights``: target weight by source; by default in proportion to the square root of its size.
    """
    refuse_clash(docs, {"block", "slot", "position"})
    own, md5, index, run = (fresh(c, docs.columns) for c in ("__source", "__md5", "__index", "__run"))
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = docs.withColumn(own, name).withColumn(md5, F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    counts = {r[own]: r["count"] for r in rows.groupBy(own).count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total = sum(counts.values())
    size = max(block_rows or 1, -(-total // MAX_BLOCKS), 1)
    if weights is None:
        shares = tempered(counts)
    else:
        given = {"" if s is None else f"={s}": w for s, w in weights.items()}
        whole = sum(given.values()) or 1
        shares = {s: max(1, round(WEIGHT_SCALE * w / whole)) if w > 0 else 0 for s, w in given.items()}
    slots, start, made = [], 0, dict.fromkeys(counts, 0)
    for at, s in enumerate(schedule({s: -(-n // size) for s, n in counts.items()}, shares)):
        slots.append((s, made[s], at, start))
        start += min(size, counts[s] - made[s] * size)
        made[s] += 1
    # At most MAX_BLOCKS + MAX_SOURCES rows.
    plan = docs.sparkSession.createDataFrame(slots, f"{own}_p string, {run}_p long, {run}_slot long, {run}_start long")
    numbered = dense_index(rows, [own], md5, [id_col], index, total)
    numbered = numbered.withColumn(run, F.floor(F.col(index) / size).cast("long"))
    placed = numbered.join(F.broadcast(plan), (F.col(own) == F.col(f"{own}_p")) & (F.col(run) == F.col(f"{run}_p")))
    return placed.select(*[F.col(c) for c in docs.columns], F.col(run).alias("block"), F.col(f"{run}_slot").alias("slot"), (F.col(f"{run}_start") + F.col(index) % size).alias("position"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "block", "slot", "position")

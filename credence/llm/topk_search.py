"""Operator 8: exact top-k inner-product search by pivot-table elimination.

Vectors are scaled to integers and cut into blocks of rows with the same nearest pivot.  A table of
distances to PIVOTS pivots is computed once.  By the triangle inequality |d(q, p) - d(x, p)| <= d(q, x) for
every pivot p; the largest of these lower bounds gives an upper bound on the inner product,
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2.

1. Queries, in packs, meet the blocks' summaries (least and greatest distance to each pivot), not their
   vectors.  The blocks with the best bounds are scored first, which gives each query a k-th score.
2. The summaries are read again: only pairs of a pack and a block whose bound reaches the k-th score of
   some query of the pack are left.
3. Those blocks meet the packs.  Each query visits its blocks in the order of its own bounds, skips the rows
   whose bounds, by a few pivots, cannot reach its k-th score so far, and stops at the first block that cannot.

What is skipped is provably below the k-th score, so the result is exact.  Scores are integers: sums that
fit a double's 53 bits are computed in doubles, larger ones in 64-bit integers, still larger ones in
integers of any size; a score that no long can hold is an error.

Queries are a stated set (ids divisible by a number) against all rows: it is cut into packs, and no task
holds more than GROUP_BLOCKS blocks and one pack, or a chunk of summaries and a few packs.

Defined cases: a vector that is null, empty or holds a null or non-finite component takes no part; vectors
are compared with those of the same length only; rows with equal ids are different candidates, and only
the query's own row is left out; ties go to the smaller id, and a null id comes after the others; a null id
is a candidate but no query; fewer than k candidates give all of them; an empty table gives none; ids that
are no whole numbers are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.llm.common import materialize, table, worker_state

SCALE = 64
PIVOTS = 48
#: Pivots that bound single rows; blocks are bounded by all.
ROW_PIVOTS = 4
#: Rows in a block, blocks that a task meets at once, bytes of rows that a task sorts into blocks at once.
BLOCK, GROUP_BLOCKS, BUFFER_BYTES = 512, 64, 1 << 22
#: Summaries in a chunk, packs that meet a chunk at once.
CHUNK, PACKS = 1024, 8
#: Blocks that are scored first, for each pack.
FIRST = 8
#: Rows from which the pivots are chosen: pivots only steer the elimination, any will do.
PIVOT_SAMPLE = 2000


def _pivots(sample: list[list[float]], n: int):
    """Farthest-first pivots of each length that occurs in the sample."""
    import numpy as np

    out = {}
    by_length: dict[int, list] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    for length, rows in by_length.items():
        x = np.floor(SCALE * np.asarray(rows, "f8"))
        chosen = [0]
        gap = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(n, len(x)):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[length] = x[chosen]
    return out


def _distances(x, pivots):
    """Distances to each pivot, from differences: no digits are lost between near vectors."""
    import numpy as np

    if pivots is None:
        return np.zeros((len(x), 1))
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def exact_scores(q, x):
    """Inner products of integer rows as int64."""
    import numpy as np

    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q @ x.T).astype("i8")
    if most < 2.0**62 and max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 2.0**62:
        return q.astype("i8") @ x.T.astype("i8")
    a, b = ([[int(v) for v in row] for row in m.tolist()] for m in (q, x))
    out = [[sum(map(int.__mul__, r, s)) for s in b] for r in a]
    if any(not -(1 << 63) <= v < 1 << 63 for row in out for v in row):
        raise OverflowError("a score is larger than a long")
    return np.array(out, "i8").reshape(len(a), len(b))


def _reach(norm, size, gap):
    """Upper bounds on scores, with slack for rounding; what overflows bounds nothing."""
    import numpy as np

    bound = (norm + size - gap**2) / 2 + 1e-9 * (norm + size) + 1
    return np.where(np.isnan(bound), np.inf, bound)


def _gaps(dist, low, high):
    """Least possible distances between rows with ``dist`` and rows with distances in [low, high]."""
    import numpy as np

    gap = np.zeros((len(dist), len(low)))
    for p in range(dist.shape[1]):
        d = dist[:, p][:, None]
        np.maximum(gap, np.maximum(low[None, :, p] - d, d - high[None, :, p]), out=gap)
    return np.nan_to_num(gap, nan=0.0)


def _telling(dist, rows):
    """The ROW_PIVOTS pivots to which queries and rows have the most different distances.  Any pivots give true
    bounds; with all of them the bounds of single rows cost more than their scores."""
    import numpy as np

    return np.argsort(-np.nan_to_num(np.abs(dist.mean(0) - rows.mean(0))), kind="stable")[:ROW_PIVOTS]


def _pack(x) -> bytes:
    """Integers in the smallest type that holds them all, named by the first byte."""
    import numpy as np

    most = np.abs(x).max(initial=0)
    kind = next((t for t, limit in (("1", 2**7), ("2", 2**15), ("4", 2**31)) if most < limit), "8")
    return kind.encode() + x.astype("f8" if kind == "8" else f"i{kind}").tobytes()


def _unpack(data: bytes, n: int):
    import numpy as np

    kind = chr(data[0])
    return np.frombuffer(data, "f8" if kind == "8" else f"i{kind}", offset=1).astype("f8").reshape(n, -1)


PARTS = "kind string, part long, length int, n int, ids binary, known binary, rows binary, vectors binary, dist binary, low binary, high binary, top double"


def _parts(pivots, every: int):
    """Arrow batches of (id, row, vector) -> blocks of rows and packs of queries."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from pyspark import TaskContext

        worker_state("topk_search")
        binary = ("ids", "known", "rows", "vectors", "dist", "low", "high")
        schema = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("length", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in binary], ("top", pa.float64())])
        made = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def cut(length: int) -> Iterator:
            nonlocal made
            x, ids, known, rows = (np.concatenate(c) for c in zip(*held.pop(length)))
            size.pop(length)
            table_ = _distances(x, pivots.get(length))
            order = np.lexsort([table_.min(1), table_.argmin(1)])
            picks = [("block", order[a : a + BLOCK]) for a in range(0, len(order), BLOCK)]
            asked = order[known[order] & (ids[order] % every == 0)]
            picks += [("pack", asked)] if len(asked) else []
            for kind, at in picks:
                d = table_[at]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "kind": kind, "part": made, "length": length, "n": len(at), "ids": ids[at].tobytes(), "known": known[at].tobytes(), "rows": rows[at].tobytes(), "vectors": _pack(x[at]),
                            "dist": d.tobytes(), "low": d.min(0).tobytes(), "high": d.max(0).tobytes(), "top": float((x[at] ** 2).sum(1).max()),
                        }
                    ],
                    schema=schema,
                )
                made += 1

        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            ids = np.where(known, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), 0).astype("i8")
            rows = batch.column(1).to_numpy(zero_copy_only=False).astype("i8")
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("f8")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for length in map(int, np.unique(lengths)):
                at = np.flatnonzero(lengths == length)
                x = np.floor(SCALE * flat[(ends[at] - length)[:, None] + np.arange(length)[None, :]])
                held.setdefault(length, []).append((x, ids[at], known[at], rows[at]))
                size[length] = size.get(length, 0) + x.nbytes
            while sum(size.values()) > BUFFER_BYTES:  # the fullest first
                yield from cut(max(size, key=size.get))
        for length in list(held):
            yield from cut(length)

    return run


def _bounds(keep):
    """Packs of queries (right) against a chunk of summaries (left): rows (pack, block, value) by ``keep``."""

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("length", pa.int32()), ("pack", pa.int64()), ("block", pa.int64()), ("value", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        low, high = (np.stack([np.frombuffer(v, "f8") for v in left.column(c).to_pylist()]) for c in ("low", "high"))
        top, parts, out = left.column("top").to_numpy(), left.column("part").to_numpy(), []
        for row in right.to_pylist():
            dist = np.frombuffer(row["dist"], "f8").reshape(row["n"], -1)
            norm = (_unpack(row["vectors"], row["n"]) ** 2).sum(1)
            bound = _reach(norm[:, None], top[None, :], _gaps(dist, low, high))
            tau = np.full(row["n"], -np.inf) if row["tau"] is None else np.frombuffer(row["tau"], "f8")
            at, value = keep(bound, tau)
            out.append(pa.table([pa.array(np.full(len(at), v), t) for v, t in ((row["length"], pa.int32()), (row["part"], pa.int64()))] + [pa.array(parts[at]), pa.array(value.astype("f8"))], schema=schema))
        return pa.concat_tables(out)

    return run


def _best_blocks(bound, tau):
    """The FIRST blocks by their mean bound over the queries of the pack."""
    import numpy as np

    total = np.nan_to_num(bound, posinf=1e300).mean(0)
    at = np.argsort(-total, kind="stable")[:FIRST]
    return at, total[at]


def _reaching_blocks(bound, tau):
    import numpy as np

    slack = (bound - tau[:, None]).max(0)
    at = np.flatnonzero(~(slack < 0))
    return at, np.nan_to_num(slack[at], posinf=1e300)


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k = k
        self.score, self.ids = np.zeros((n, k), "i8"), np.zeros((n, k), "i8")
        self.known, self.valid = np.zeros((n, k), bool), np.zeros((n, k), bool)

    def kth(self):
        import numpy as np

        return np.where(self.valid[:, -1], self.score[:, -1].astype("f8"), -np.inf)

    def add(self, at, score, ids, known, valid):
        """Scores (rows ``at`` times candidates) of candidates with ``ids``."""
        import numpy as np

        # What is below the k-th score so far, or below the k-th of these, never enters; equal scores may.
        least = np.iinfo("i8").min
        floor = np.where(self.valid[at, -1], self.score[at, -1], least)
        if score.shape[1] > self.k:
            own = np.where(valid, score, least)
            floor = np.maximum(floor, np.partition(own, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k])
        row, col = np.nonzero(valid & (score >= floor[:, None]))
        if not len(row):
            return
        here, place = np.unique(row, return_inverse=True)
        at = at[here]
        old, slot = np.nonzero(self.valid[at])
        row = np.concatenate([old, place])
        s, i, n = (np.concatenate([kept[at[old], slot], new]) for kept, new in ((self.score, score[here[place], col]), (self.ids, ids[col]), (self.known, known[col])))
        order = np.lexsort([i, ~n, ~s, row])
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, rank = (x[rank < self.k] for x in (order, row, rank))
        self.score[at[row], rank], self.ids[at[row], rank], self.known[at[row], rank], self.valid[at[row], rank] = s[order], i[order], n[order], True


def _search(k: int, only_tau: bool):
    """One pack of queries (right, one row) against a group of blocks (left)."""

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        worker_state("topk_search")
        fields = [("pack", pa.int64()), ("tau", pa.binary())] if only_tau else [("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
        schema = pa.schema(fields)
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q = right.slice(0, 1).to_pylist()[0]
        nq = q["n"]
        x, dist = _unpack(q["vectors"], nq), np.frombuffer(q["dist"], "f8").reshape(nq, -1)
        own, norm = np.frombuffer(q["rows"], "i8"), (x**2).sum(1)
        tau = np.full(nq, -np.inf) if q["tau"] is None else np.frombuffer(q["tau"], "f8")
        blocks = left.to_pylist()
        low, high = (np.stack([np.frombuffer(b[c], "f8") for b in blocks]) for c in ("low", "high"))
        limit = _reach(norm[:, None], np.array([b["top"] for b in blocks])[None, :], _gaps(dist, low, high))
        order = np.argsort(-limit, axis=1, kind="stable")
        best = _Best(nq, k)
        going = np.ones(nq, bool)
        for step in range(len(blocks)):
            here = order[:, step]
            going &= limit[np.arange(nq), here] >= np.maximum(best.kth(), tau)
            for j in np.unique(here[going]):
                at = np.flatnonzero(going & (here == j))
                b = blocks[j]
                if "x" not in b:
                    b["x"] = _unpack(b["vectors"], b["n"])
                    b["size"] = (b["x"] ** 2).sum(1)
                    b["d"] = np.frombuffer(b["dist"], "f8").reshape(b["n"], -1)
                some = _telling(dist[at], b["d"])
                bound = _reach(norm[at][:, None], b["size"][None, :], _gaps(dist[at][:, some], b["d"][:, some], b["d"][:, some]))
                columns = np.flatnonzero((bound >= np.maximum(best.kth(), tau)[at][:, None]).any(0))
                if len(columns):
                    rows = np.frombuffer(b["rows"], "i8")[columns]
                    best.add(at, exact_scores(x[at], b["x"][columns]), np.frombuffer(b["ids"], "i8")[columns], np.frombuffer(b["known"], "?")[columns], own[at][:, None] != rows[None, :])
        if only_tau:
            return pa.table([pa.array([q["part"]], pa.int64()), pa.array([best.kth().tobytes()], pa.binary())], schema=schema)
        r, c = np.nonzero(best.valid)
        ids = np.frombuffer(q["ids"], "i8")
        return pa.table([pa.array(ids[r]), pa.array(own[r]), pa.array(best.ids[r, c], mask=~best.known[r, c]), pa.array(best.score[r, c])], schema=schema)

    return run


def exact_top_k(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query."""
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} is no whole number")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()]
    numbered = rows.select("id", F.monotonically_increasing_id().alias("row"), "v")
    parts = materialize(numbered.mapInArrow(_parts(_pivots(sample, PIVOTS), every), PARTS), "topk-parts")
    blocks, packs = parts.filter("kind = 'block'"), parts.filter("kind = 'pack'")
    n = {r["kind"]: r["count"] for r in parts.groupBy("kind").count().collect()}
    chunks, crowds = (max(1, -(-n.get(c, 0) // size)) for c, size in (("block", CHUNK), ("pack", PACKS)))
    every_one = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda m: F.pmod(F.xxhash64("part"), F.lit(m)).cast("int")

    def bounded(asked: DataFrame, keep) -> DataFrame:
        left = blocks.select("length", "part", "low", "high", "top", deal(chunks).alias("chunk")).withColumn("crowd", every_one(crowds))
        right = asked.select("length", "part", "n", "vectors", "dist", "tau", deal(crowds).alias("crowd")).withColumn("chunk", every_one(chunks))
        keys = ("length", "chunk", "crowd")
        right = right.toDF(*right.columns)  # both sides come from one table
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_bounds(keep), "length int, pack long, block long, value double")

    def searched(asked: DataFrame, pairs: DataFrame, groups: int, only_tau: bool, schema: str) -> DataFrame:
        pairs = pairs.select(F.col("pack").alias("p"), F.col("block").alias("b"), F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("grp"))
        left = blocks.select("part", "n", "ids", "known", "rows", "vectors", "dist", "low", "high", "top").join(pairs, F.col("part") == F.col("b")).drop("part", "b")
        right = asked.select("part", "n", "ids", "rows", "vectors", "dist", "tau").join(pairs.select(F.col("p").alias("p_"), "grp").distinct(), F.col("part") == F.col("p_")).withColumn("p", F.col("p_"))
        right = right.toDF(*right.columns)
        return left.groupBy("p", "grp").cogroup(right.groupBy("p", "grp")).applyInArrow(_search(k, only_tau), schema)

    order = Window.partitionBy("pack").orderBy(F.desc("value"), "block")
    asked = packs.withColumn("tau", F.lit(None).cast("binary"))
    first = bounded(asked, _best_blocks).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= FIRST)
    tau = materialize(searched(asked, first, 1, True, "pack long, tau binary"), "topk-thresholds")
    asked = packs.join(tau, F.col("part") == F.col("pack"), "left").drop("pack")
    reached = materialize(bounded(asked, _reaching_blocks), "topk-pairs")
    found = searched(asked, reached, max(1, -(-n.get("block", 0) // GROUP_BLOCKS)), False, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH e AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

"""Operator 7: n-gram Jaccard join of documents as a grouped prefix join.

A document is the set of its distinct five-word shingles (64-bit hashes).  Two sets with a Jaccard
similarity of 3/4 or more share a token in their prefixes: the first n - ceil(3n/4) + 1 tokens in any one
order of all tokens.  The order here is: rare tokens by hash, then the frequent ones by frequency, so that
passages that many documents share stay out of prefixes.  Every token is counted over the whole input:
with counts of parts of it, tokens that few documents of a part hold pass for rare, and their pairs grow
with the square of the input.

Grouping.  Documents with equal sets have equal prefixes and sizes; they are collapsed into one node
before anything is joined, whatever their number.  Nodes that share prefix tokens are candidates; they are
first linked to a centre per token, verified, and collapsed into components.  From then on a token counts
only where it joins different components, and pairs of groups are filtered by size before they are
expanded into their members; a pair is verified against whole sets if its sizes and the number of prefix
tokens it shares allow the threshold.  Cheap rounds run first; the last round
expands every group pair that is left, so no link between different components is missed, while pairs
inside one component are never made.

Nothing is capped: the table of frequent tokens (at most HOT_TOKENS) only changes the order of tokens, and
any order gives the same links.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; a text with one
to four words is one shingle; rows with equal ids are separate documents (they get numbers of their own
first); a null id is a document whose number comes after all others; very long texts are hashed in pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.llm.common import bitmap_filter, materialize, passes_filter, release, table, with_row_numbers, without_rows, worker_state

WORDS = 5
#: Tokens that are moved to the end of the order; a bound on what is broadcast (12 bytes each).
HOT_TOKENS = 1 << 20
#: A token is frequent from this many documents on.
HOT_FROM = 6
#: Shingles a task holds before it counts or sends them.
FLUSH = 1 << 19
PIECE = 1 << 18
#: Postings per bucket that the number of buckets aims at.
BUCKET_POSTINGS = 300_000


@functools.lru_cache(maxsize=1)
def _tables():
    """Fixed random numbers: one per byte, and the multipliers of words and shingles."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(20240229))
    value = rng.integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
    for upper in range(65, 91):
        value[upper] = value[upper + 32]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return value, space, rng.integers(0, 1 << 62, WORDS, dtype="u8") * np.uint64(2) + np.uint64(1)


BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def _powers():
    import numpy as np

    n = PIECE + 1
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, "u8"), np.full(n, INVERSE, "u8")
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: bytes):
    import numpy as np

    value, space, _ = _tables()
    up, down = _powers()
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):  # cut behind white space; a longer word than PIECE goes whole, in Python
            cut = max(data.rfind(bytes([c]), at, end) for c in (32, 9, 10, 11, 12, 13))
            if cut < 0:
                stop = min((p for p in (data.find(bytes([c]), end) for c in (32, 9, 10, 11, 12, 13)) if p >= 0), default=len(data))
                total, power = 0, 1
                for b in data[at:stop]:
                    total = (total + int(value[b]) * power) % (1 << 64)
                    power = power * BASE % (1 << 64)
                out.append(np.array([total], "u8"))
                at = stop
                continue
            end = cut + 1
        a = np.frombuffer(data, "u1", end - at, at)
        gap = space[a]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype("i1")))
        starts, ends = edge[::2], edge[1::2]
        total = np.concatenate([[np.uint64(0)], np.cumsum(value[a] * up[: len(a)], dtype="u8")])
        out.append((total[ends] - total[starts]) * down[starts])
        at = end
    return _mix(np.concatenate(out)) if out else np.zeros(0, "u8")


def shingles(text: str | None):
    """The sorted distinct shingle hashes of a text."""
    import numpy as np

    if not text:
        return np.zeros(0, "u8")
    w = _word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    factor = _tables()[2]
    n = min(WORDS, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, "u8")
        for k in range(n):
            h = (h ^ (h >> np.uint64(32))) + w[k : len(w) - n + 1 + k] * factor[k]
        return np.unique(_mix(h))


def signature(tokens) -> tuple[int, int]:
    import numpy as np

    return int(np.bitwise_xor.reduce(_mix(tokens), initial=np.uint64(0)).astype("i8")), int(tokens.sum(dtype="u8").astype("i8"))


def _count_key(buckets: int) -> int:
    """The bits of a token by which it is counted: the upper 32, and those of its bucket.  Tokens that
    agree in them share a count and a place in the order, which may be any."""
    return 0xFFFFFFFF00000000 | (buckets - 1)


STATS = "bucket long, id long, n long, sig long, sig2 long, once binary, often binary, often_n binary"


def _stats(buckets: int):
    """Per document: size and signature (negative buckets); per FLUSH shingles: those of each bucket, the
    ones of a single set without their number."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        worker_state("ngram_join")

        schema = pa.schema([(c, pa.binary() if c.startswith("o") else pa.int64()) for c in ("bucket", "id", "n", "sig", "sig2", "once", "often", "often_n")])
        held, size, seen = [], 0, set()

        def counted():
            tokens = np.concatenate(held)
            low = (tokens & np.uint64(buckets - 1)) << np.uint64(32)
            tokens = np.sort(low | (tokens >> np.uint64(32)))  # by bucket, then by the upper bits
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            n = np.diff(np.concatenate([first, [len(tokens)]]))
            tokens = tokens[first]
            bucket, upper = (tokens >> np.uint64(32)).astype("i8"), tokens.astype("<u4")
            cut = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for a, b in zip([0, *cut], [*cut, len(bucket)]):
                part, many = upper[a:b], n[a:b] > 1
                rows.append((part[~many].tobytes(), part[many].tobytes(), n[a:b][many].astype("<u4").tobytes()))
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(bucket[[0, *cut]]), none, none, none, none, *(pa.array(c, pa.binary()) for c in zip(*rows))], schema=schema)

        for batch in batches:
            ids, n, a, b = batch.column(0), [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                x, y = signature(s)
                n.append(len(s)), a.append(x), b.append(y)
                if len(s) and (x, y) not in seen:  # copies say nothing about the order of tokens
                    seen.add((x, y))
                    held.append(s)
                    size += len(s)
                if size >= FLUSH:
                    yield counted()
                    held, size, seen = [], 0, set()
            none = pa.nulls(len(n), pa.binary())
            place = pa.array(-1 - (_mix(ids.to_numpy(zero_copy_only=False).astype("u8")) & np.uint64(buckets - 1)).astype("i8"))
            yield pa.RecordBatch.from_arrays([place, ids, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none, none], schema=schema)
        if held:
            yield counted()

    return run


def _counts(key, group):
    """The documents of a negative bucket as they are; of another one, the tokens that HOT_FROM sets hold."""
    import numpy as np
    import pyarrow as pa

    bucket = key[0].as_py()
    docs = [group.column(c) for c in ("id", "n", "sig", "sig2")]
    names = ["id", "n", "sig", "sig2", "hot", "hot_n"]
    if bucket < 0:
        none = pa.nulls(group.num_rows, pa.int64())
        return pa.table([*docs, none, none], names=names)
    once, often, often_n = (np.frombuffer(b"".join(group.column(c).to_pylist()), "<u4") for c in ("once", "often", "often_n"))
    tokens, n = np.concatenate([once, often]), np.concatenate([np.ones(len(once), "i8"), often_n.astype("i8")])
    order = np.argsort(tokens, kind="stable")
    tokens, n = tokens[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    total = np.add.reduceat(n, first)
    hot = total >= HOT_FROM
    tokens = (tokens[first][hot].astype("u8") << np.uint64(32)) | np.uint64(bucket)
    none = pa.nulls(len(tokens), pa.int64())
    return pa.table([none, none, none, none, pa.array(tokens.view("i8")), pa.array(total[hot])], names=names)


def _order(often: DataFrame):
    """(tokens, rank) of the most frequent tokens of ``often`` (hot, k), sorted by token; the most frequent
    have the highest rank.  At most HOT_TOKENS reach the driver: of one count, all or none."""
    import numpy as np

    least, n = None, 0
    for r in often.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).toLocalIterator():
        n += r["n"]
        if n > HOT_TOKENS:
            break
        least = r["k"]
    if least is None:
        return np.zeros(0, "u8"), np.zeros(0, "i4")
    got = often.filter(F.col("k") >= least).toArrow()
    tokens, k = got.column("hot").to_numpy().view("u8"), got.column("k").to_numpy()
    rank = np.empty(len(tokens), "i4")
    rank[np.lexsort([tokens, k])] = np.arange(len(tokens), dtype="i4")
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def prefix_lengths(n: int) -> tuple[int, int]:
    """How many tokens a set of ``n`` shows to larger sets, and to smaller ones: a set that is at least as
    large as this one shares 6/7 of its tokens, a smaller one 3/4."""
    return n - -(-6 * n // 7) + 1, n - -(-3 * n // 4) + 1


def prefix(tokens, hot, rank, key: int = -1):
    """(rare, frequent) tokens of the prefix, in order; ``key`` has the bits by which tokens are in ``hot``."""
    import numpy as np

    n = len(tokens)
    length = prefix_lengths(n)[1]
    if len(hot):
        keys = tokens & np.uint64(key % (1 << 64))
        at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        is_hot = hot[at] == keys
        cold = tokens[~is_hot]
        if len(cold) >= length:
            return cold[:length], tokens[:0]
        late = tokens[is_hot]
        return cold, late[np.argsort(rank[at[is_hot]], kind="stable")][: length - len(cold)]
    return tokens[:length], tokens[:0]


def _postings(sent, buckets: int, key: int = -1):
    """Packed (token, signature) postings; frequent tokens are salted by signature (negative buckets)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        worker_state("ngram_join")
        hot, rank = (np.frombuffer(x, t) for x, t in zip(sent.value, ("u8", "i4")))
        names = ["bucket", "tokens", "sigs"]
        cold_parts, hot_parts, size, seen = [], [], 0, set()

        def packed():
            rows = []
            for parts, salted in ((cold_parts, False), (hot_parts, True)):
                if not parts:
                    continue
                t = np.concatenate([p[0] for p in parts])
                s = np.repeat(np.array([p[1] for p in parts], "i8"), [len(p[0]) for p in parts])
                key = -1 - (s.view("u8") % np.uint64(buckets)).astype("i8") if salted else (t % np.uint64(buckets)).astype("i8")
                order = np.argsort(key, kind="stable")
                key, t, s = key[order], t[order], s[order]
                cut = np.flatnonzero(np.diff(key)) + 1
                for a, b in zip([0, *cut], [*cut, len(key)]):
                    rows.append((int(key[a]), t[a:b].tobytes(), s[a:b].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=names)

        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py())
                if not len(s):
                    continue
                sig = signature(s)[0] & ~1  # the lowest bit marks the tokens that larger sets must meet
                if sig in seen:
                    continue
                seen.add(sig)
                cold, late = prefix(s, hot, rank, key)
                first = prefix_lengths(len(s))[0]
                for parts, own, shown in ((cold_parts, cold, min(first, len(cold))), (hot_parts, late, max(0, first - len(cold)))):
                    if shown:
                        parts.append((own[:shown], sig | 1))
                    if shown < len(own):
                        parts.append((own[shown:], sig))
                size += len(cold) + len(late)
                if size >= FLUSH:
                    yield packed()
                    cold_parts, hot_parts, size, seen = [], [], 0, set()
        if size:
            yield packed()

    return run


def _shared(key, group):
    """The postings of one bucket whose token has two different signatures or more."""
    import numpy as np
    import pyarrow as pa

    t = np.concatenate([np.frombuffer(b.as_py(), "u8") for b in group.column("tokens")])
    s = np.concatenate([np.frombuffer(b.as_py(), "i8") for b in group.column("sigs")])
    order = np.lexsort([s, t])
    t, s = t[order], s[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
    t, s = t[first], s[first]
    if key[0].as_py() >= 0 and len(t):  # a set holds a token once, so its rows differ in the token
        same = np.concatenate([[False], t[1:] == t[:-1], [False]])
        keep = same[1:] | same[:-1]
        t, s = t[keep], s[keep]
    return pa.table({"token": pa.array(t.view("i8")), "sig": pa.array(s)})


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tokens) of the documents in ``ids`` and perhaps a few others; the rest never leaves the scan."""
    bitmap, n_bits = bitmap_filter(ids.select(F.xxhash64("id").alias("h")), "h")
    picked = passes_filter(docs, F.xxhash64("id"), bitmap, n_bits, "may").filter("may").select("id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(v.as_py()).tobytes() for v in part.column(1)], pa.binary())], names=["id", "tokens"])

    return picked.mapInArrow(run, "id long, tokens binary")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), "u8"), np.frombuffer(y.as_py(), "u8")
                common = len(x) + len(y) - len(np.union1d(x, y))
                good.append(7 * common >= 3 * (len(x) + len(y)))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    left = sets.select(F.col("id").alias("ia"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("ib"), F.col("tokens").alias("tb"))
    both = pairs.join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib"))
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id in ``edges`` (a, b): alternating large and small stars, each round written
    to a table, until nothing changes; comp is the smallest id of the component."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = e.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), F.least("a", "low").alias("low"))
        j = e.join(low, F.col("a") == F.col("k"))
        if large:
            out = j.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = j.filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("k").alias("a"), F.col("low").alias("b")))
        return out.filter("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.filter("a <> b").distinct(), "edges")
    before = None
    while (seen := mark(now)) != before:
        before = seen
        after = materialize(star(star(now, True), False), "edges")
        release(now)
        now = after
    out = materialize(now.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("comp"))).distinct(), "components")
    release(now)
    return out


def _near(rows: DataFrame) -> DataFrame:
    """(id, n, comp) of ``rows`` (id long, unique and not null; text)."""
    spark = rows.sparkSession
    # A shingle for each seven bytes or so; the number of buckets only bounds what a group holds.
    expected, count_buckets = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 7, 64
    while count_buckets * BUCKET_POSTINGS * 4 < expected and count_buckets < 1 << 20:
        count_buckets *= 2
    counted = rows.select("id", "text").mapInArrow(_stats(count_buckets), STATS).groupBy("bucket").applyInArrow(_counts, "id long, n long, sig long, sig2 long, hot long, hot_n long")
    stats = materialize(counted, "shingle-stats")
    own = stats.filter("n IS NOT NULL")
    tokens, rank = _order(stats.filter("hot IS NOT NULL").select("hot", F.col("hot_n").alias("k")))
    sent = spark.sparkContext.broadcast((tokens.tobytes(), rank.tobytes()))

    # Groups of equal sets become one node, named after its smallest id.
    nodes = materialize(own.filter("n > 0").groupBy("sig", "sig2", "n").agg(F.min("id").alias("id")), "shingle-nodes")
    total = own.agg(F.sum("n")).first()[0] or 0
    buckets = 64
    while buckets * BUCKET_POSTINGS * 4 < total and buckets < 1 << 20:
        buckets *= 2
    packed = rows.select("text").mapInArrow(_postings(sent, buckets, _count_key(count_buckets)), "bucket long, tokens binary, sigs binary")
    shared = packed.groupBy("bucket").applyInArrow(_shared, "token long, sig long")
    marked = shared.withColumn("shown", F.col("sig").bitwiseAND(F.lit(1)) == 1).withColumn("sig", F.col("sig").bitwiseAND(F.lit(-2)))
    live = materialize(marked.join(nodes.select(F.col("sig").bitwiseAND(F.lit(-2)).alias("s"), "id", "n"), F.col("sig") == F.col("s")).select("token", "id", "n", "shown"), "shingle-live")
    comps = None
    scratch = [stats, nodes, live]
    if live.limit(1).count():
        comps = _resolve(live, rows)
    nodes_comp = nodes.select("sig", "sig2", "n", F.col("id").alias("node"))
    if comps is not None:
        nodes_comp = nodes_comp.join(comps.withColumnRenamed("id", "cid"), F.col("node") == F.col("cid"), "left").select("sig", "sig2", "n", F.coalesce("comp", "node").alias("comp"))
    else:
        nodes_comp = nodes_comp.withColumnRenamed("node", "comp")
    labelled = nodes_comp.select(F.col("sig").alias("s"), F.col("sig2").alias("s2"), F.col("n").alias("m"), "comp")
    out = own.join(labelled, (F.col("sig") == F.col("s")) & (F.col("sig2") == F.col("s2")) & (F.col("n") == F.col("m")), "left")
    out = materialize(out.select("id", "n", F.coalesce("comp", "id").alias("comp")), "near-duplicates")
    for x in scratch:
        release(x)
    return out


def _rest(n: str):
    """Tokens of a set behind its prefix."""
    return F.ceil(3 * F.col(n) / 4) - 1


def _may_reach(shared: str):
    """Of two sets, the one whose prefix ends earlier has all its common tokens up to that end among the
    ``shared`` prefix tokens, so the overlap is at most ``shared`` plus the tokens behind a prefix."""
    return 7 * (F.col(shared) + F.greatest(_rest("na"), _rest("nb"))) >= 3 * (F.col("na") + F.col("nb"))


def _fits():
    """Sizes that can reach the threshold."""
    return (4 * F.least("na", "nb")) >= (3 * F.greatest("na", "nb"))


def _centre_pairs(own: DataFrame) -> DataFrame:
    """One member of each group on a token against the token's centre; a node keeps the three centres
    that share most tokens with it.  What is left out here waits for the last round."""
    groups = own.groupBy("token", "comp").agg(F.min(F.struct("id", "n")).alias("m"), F.first("mid").alias("mid"))
    pairs = groups.filter(F.col("mid.comp") != F.col("comp")).select(F.col("m.id").alias("a"), F.col("m.n").alias("na"), F.col("mid.id").alias("b"), F.col("mid.n").alias("nb"))
    pairs = pairs.filter(_fits()).groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("shared")).filter(_may_reach("shared"))
    best = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    return pairs.withColumn("k", F.row_number().over(best)).filter("k <= 3").select("a", "b")


def _all_pairs(own: DataFrame) -> DataFrame:
    """Every pair of members of different groups that the sizes and the shared prefix tokens allow.

    The smaller of two similar sets has a common token among its ``shown`` ones (both have, if they are
    as large), and the larger has it in its prefix; such pairs are then held against both whole prefixes.
    """
    small = own.filter("shown").groupBy("token", "comp").agg(F.min("n").alias("la"), F.max("n").alias("ha")).withColumnRenamed("comp", "ca")
    large = own.groupBy(F.col("token").alias("t"), F.col("comp").alias("cb")).agg(F.min("n").alias("lb"), F.max("n").alias("hb"), F.max(F.when(F.col("shown"), F.col("n"))).alias("eb"))
    fit = (F.col("ca") != F.col("cb")) & (F.col("la") <= F.col("hb")) & (4 * F.col("ha") >= 3 * F.col("lb"))
    met = small.join(large, (F.col("token") == F.col("t")) & fit).select("token", "ca", "cb", "lb", "hb", "eb")
    one = own.filter("shown").select(F.col("token").alias("t1"), F.col("comp").alias("c1"), F.col("id").alias("a"), F.col("n").alias("na"))
    two = own.select(F.col("token").alias("t2"), F.col("comp").alias("c2"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shown").alias("sb"))
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & F.col("sb") & (F.col("a") < F.col("b")))
    # A member is expanded only if some member of the other group is larger, or as large and shows the token.
    reach = (4 * F.col("na") >= 3 * F.col("lb")) & ((F.col("na") < F.col("hb")) | (F.col("na") == F.col("eb")))
    pairs = met.join(one, (F.col("token") == F.col("t1")) & (F.col("ca") == F.col("c1")) & reach).join(two, (F.col("token") == F.col("t2")) & (F.col("cb") == F.col("c2")) & order & _fits())
    pairs = pairs.select("a", "na", "b", "nb").distinct()
    # A prefix is as long as its set at most; only the tokens that other groups share are left of it.
    prefixes = own.groupBy("id").agg(F.collect_list("token").alias("tokens"))
    both = pairs.join(prefixes.select(F.col("id").alias("ia"), F.col("tokens").alias("ta")), F.col("a") == F.col("ia")).join(prefixes.select(F.col("id").alias("ib"), F.col("tokens").alias("tb")), F.col("b") == F.col("ib"))
    return both.withColumn("shared", F.size(F.array_intersect("ta", "tb"))).filter(_may_reach("shared")).select("a", "b")


def _resolve(live: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Components of the nodes in ``live`` (token, id, n, shown): cheap rounds, then all that is left."""
    edges, comps, found = None, None, None
    for step in ("centre", "centre", "all"):
        if step == "centre" and found is not None and not found.limit(1).count():
            continue
        if comps is None:
            own = live.withColumn("comp", F.col("id"))
        else:
            c = comps.select(F.col("id").alias("cid"), "comp")
            own = live.join(c, F.col("id") == F.col("cid"), "left").select("token", "id", "n", "shown", F.coalesce("comp", "id").alias("comp"))
        mixed = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("id", "n", "comp")).alias("mid")).filter("lo < hi")
        own = own.join(mixed.select(F.col("token").alias("t"), "mid"), F.col("token") == F.col("t")).select("token", "id", "n", "shown", "comp", "mid")
        if step == "all":
            own = materialize(own, "group-postings")
        pairs = materialize((_centre_pairs if step == "centre" else _all_pairs)(own), "pairs")
        release(own)
        if not pairs.limit(1).count():
            found = pairs
            continue
        sets = materialize(_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "shingle-sets")
        found = materialize(_links(pairs, sets), "links")
        release(sets)
        release(pairs)
        if not found.limit(1).count():
            continue
        edges = found if edges is None else materialize(edges.unionByName(found), "links")
        if comps is not None:
            release(comps)
        comps = components(edges)
    return comps


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id that links lead to.  Ids are of any
    type that can be ordered."""
    numbered, number = with_row_numbers(docs.select(F.col(id_col).alias("own"), F.col(text).alias("text")), "own")
    found = _near(numbered.select(F.col(number).cast("long").alias("id"), "text"))
    if number == "own":
        return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    named = found.join(numbered.select(F.col(number).alias("r"), "own"), F.col("id") == F.col("r"))
    low = named.groupBy("comp").agg(F.min("own").alias("low")).select(F.col("comp").alias("c"), "low")
    return named.join(low, F.col("comp") == F.col("c")).select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (of equal ids, any one)."""
    numbered, number = with_row_numbers(docs, id_col)
    found = _near(numbered.select(F.col(number).cast("long").alias("id"), F.col(text).alias("text")))
    if number == id_col:
        gone = found.filter("id <> comp").select("id")
    else:
        ids = numbered.select(F.col(number).alias("r"), F.col(id_col).alias("own"))
        named = found.join(ids, F.col("id") == F.col("r"))
        low = named.groupBy("comp").agg(F.min(F.struct(F.col("own").isNull(), "own", "id")).alias("low")).select(F.col("comp").alias("c"), F.col("low.id").alias("stays"))
        gone = materialize(named.join(low, F.col("comp") == F.col("c")).filter("id <> stays").select("id"), "near-copies")
    return without_rows(numbered, number, gone).select(*docs.columns)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))

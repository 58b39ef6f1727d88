"""Operator 12: phrase collocations from word-id suffix arrays.

A task cuts its texts into shards of a few megabytes.  A shard's words become ids of its own dictionary, its suffixes
are sorted by numpy prefix doubling up to the phrase length, and the runs of neighbours with a common prefix
of m words (LCP intervals) are the distinct phrases of m words with their counts.  Counts are merged by
(group, phrase) over all shards, first inside a task and then by one shuffle.

Phrases are counted length by length: one of m words can only reach the least count if both phrases of m - 1
words inside it do.  Those that do are told to the tasks as a bitmap of a fixed bound, which lets through all of
them and some others; it saves sorting and shuffling and never changes a count that matters.

Defined cases: a null text is empty; a null group is ``und``, one with groups of that name; groups without words give no
rows; empty pieces are none; repeated rows count each time; ties go by phrase, bytewise; a text of any length is counted whole, in
shards that end between pieces (memory grows with the longest piece); an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.llm.common import bitmap_filter, materialize, release, table, worker_state

WORDS, LEAST, SHARE, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
#: Bytes of text in a shard.
SHARD = 8 << 20
COUNTS = "grp string, phrase string, f long"
TURN = 23


def _classes():
    """By byte: 0 in words, 1 between words, 2 between pieces; and the byte in lower case."""
    import numpy as np

    kind, low = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kind[[0x20, 0x09]] = 1
    kind[list(b".,;:!?\n\x0b\x0c\r")] = 2
    low[65:91] += 32
    return kind, low


def words_of(data) -> tuple:
    """(ids, dictionary, piece): the words of ``data`` (bytes) in order as numbers into a dictionary of
    their bytes, and the number of the piece that each is in."""
    import numpy as np
    import pyarrow as pa

    kinds, low = _classes()
    raw = np.frombuffer(data, np.uint8)
    kind = kinds[raw]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    ends = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=ends[1:])
    kept = low[raw[inside]]
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(kept)]).dictionary_encode()
    breaks = np.flatnonzero(kind == 2)
    return whole.indices.to_numpy().astype(np.int64), whole.dictionary, np.searchsorted(breaks, begin)


def suffix_array(ids, piece, length: int):
    """The positions of all words, sorted by the ``length`` words that begin there (fewer where the piece
    ends), by prefix doubling; and for each but the first how many of those words it shares with the one before it."""
    import numpy as np

    rank, known = ids, 1
    while known < length:
        after = np.zeros_like(rank)
        same = piece[known:] == piece[:-known]
        after[:-known][same] = rank[known:][same] + 1
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)
        known *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for m in range(length):
        last = len(ids) - 1
        x, y = np.minimum(a + m, last), np.minimum(b + m, last)
        equal = (common == m) & (a + m <= last) & (b + m <= last) & (ids[x] == ids[y]) & (piece[x] == piece[a]) & (piece[y] == piece[b])
        common += equal
    return order, common


def phrases(ids, piece, length: int):
    """(first position, count) of each distinct phrase of ``length`` words: the LCP intervals of that depth."""
    import numpy as np

    if len(ids) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, common = suffix_array(ids, piece, length)
    heads = np.flatnonzero(np.concatenate([[True], common < length]))
    counts = np.diff(np.append(heads, len(order)))
    first = order[heads]
    last = first + length - 1
    whole = (last < len(ids)) & (piece[np.minimum(last, len(ids) - 1)] == piece[first])
    return first[whole], counts[whole]


def _turned(h):
    import numpy as np

    return (h << np.uint64(TURN)) | (h >> np.uint64(64 - TURN))


def _hash(group: Column, phrase: Column) -> Column:
    """The hash of a phrase: those of its words, each turned by its distance from the end."""
    step = lambda h, w: (F.shiftleft(h, TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - TURN))).bitwiseXOR(F.xxhash64(group, w))
    return F.aggregate(F.split(phrase, " "), F.lit(0).cast("long"), step)


class Sieve:
    """A bitmap of phrases, by the hash above; inside a task."""

    def __init__(self, chunks: dict[int, bytes], bits: int):
        import numpy as np

        size = bits // 8 // max(1, (max(chunks, default=0) + 1))
        whole = b"".join(chunks.get(k, bytes(size)) for k in range(max(chunks, default=0) + 1)) if chunks else b"\0"
        self.bits, self.held = np.uint64(bits), np.frombuffer(whole, np.uint8)

    def lets(self, h):
        import numpy as np

        at = h.astype(np.int64) % np.int64(self.bits)  # as pmod: hashes are signed there
        byte = at >> 3
        there = byte < len(self.held)
        return there & ((self.held[np.where(there, byte, 0)] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _count(group: str, data: bytes, length: int, sieve: Sieve | None) -> tuple:
    """The phrases of ``length`` words in ``data`` that may reach the least count: (texts, counts), Arrow."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    ids, known, piece = words_of(data)
    total = len(ids)
    if length > 1 and total:
        seed = xxhash.xxh64_intdigest(group.encode(), 42)
        word = np.array([xxhash.xxh64_intdigest(w, seed) for w in known.to_pylist()], np.uint64)[ids]
        h, span = word, length - 1
        for k in range(1, span):
            h = _turned(h[:-1]) ^ word[k:]
        frequent = sieve.lets(h) & (piece[: len(h)] == piece[span - 1 :])
        starts = frequent[:-1] & frequent[1:] & (piece[: len(frequent) - 1] == piece[length - 1 :])
        use = np.zeros(total, bool)
        for k in range(length):
            use[k : k + len(starts)] |= starts
        # What no such phrase covers ends a piece; a phrase that crosses two of them, each covered, is sorted out below.
        run = np.cumsum(~use)[use]
        ids, piece = ids[use], piece[use] * (total + 1) + run
        open_ = np.zeros(total, bool)
        open_[: len(starts)] = starts
        first, counts = phrases(ids, piece, length)
        first, counts = first[open_[use][first]], counts[open_[use][first]]
    else:
        first, counts = phrases(ids, piece, length)
    parts = [known.take(pa.array(ids[first + k])) for k in range(length)]
    texts = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
    return texts.cast(pa.large_string()).cast(pa.string()), pa.array(counts), total


def ngram_counts(docs: DataFrame, group: Column, text: Column, length: int, sieve: tuple[dict[int, bytes], int] | None = None) -> DataFrame:
    """(grp, phrase, f): the count of each phrase of ``length`` words, and of the empty phrase for all words
    where ``length`` is 1.  With a sieve of phrases one word shorter, phrases that hold others are left out."""
    sc = docs.sparkSession.sparkContext
    told = sc.broadcast(sieve) if sieve is not None else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        worker_state("collocations")
        filter_ = Sieve(*told.value) if told is not None else None
        held: dict[str, list[bytes]] = {}

        def flush(name: str) -> Iterator:
            data = b"\n".join(held.pop(name))
            for part in _shards(data):
                texts, counts, total = _count(name, part, length, filter_)
                if len(counts):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(counts)), texts, counts], ["grp", "phrase", "f"])
                if length == 1 and total:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([""]), pa.array([total])], ["grp", "phrase", "f"])

        sizes: dict[str, int] = {}
        for batch in batches:
            for name in pc.unique(batch.column("grp")).to_pylist():
                texts = batch.column("text").filter(pc.equal(batch.column("grp"), name))
                one = pa.ListArray.from_arrays([0, len(texts)], texts)
                data = pc.binary_join(one, "\n")[0].as_buffer().to_pybytes()
                held.setdefault(name, []).append(data)
                sizes[name] = sizes.get(name, 0) + len(data)
            if sum(sizes.values()) >= SHARD:
                for name in list(held):
                    yield from flush(name)
                sizes.clear()
        for name in list(held):
            yield from flush(name)

    rows = docs.select(F.coalesce(group.cast("string"), F.lit("und")).alias("grp"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(run, COUNTS).groupBy("grp", "phrase").agg(F.sum("f").alias("f"))


def _shards(data: bytes) -> Iterator[bytes]:
    """``data`` in parts of about SHARD bytes that end between pieces."""
    import re

    at, ends = 0, re.compile(rb"[.,;:!?\x0a-\x0d]")
    while len(data) - at > SHARD:
        found = ends.search(data, at + SHARD)
        if found is None:
            break
        yield data[at : found.end()]
        at = found.end()
    yield data[at:] if at else data


def _sieve(frequent: DataFrame) -> tuple[dict[int, bytes], int]:
    """The bitmap of ``frequent`` (grp, phrase): at most 16 MB, whatever the input."""
    bitmap, bits = bitmap_filter(frequent.select(_hash(F.col("grp"), F.col("phrase")).alias("h")), "h")
    return {r["chunk"]: bytes(r["bits"]) for r in bitmap.collect()}, bits


def frequent_phrases(docs: DataFrame, group: Column, text: Column, longest: int = WORDS, least: int = LEAST) -> list[DataFrame]:
    """Tables (grp, phrase, f) of the phrases with at least ``least`` occurrences, of 1, 2, ... words; the first
    holds each group's number of words under the empty phrase as well."""
    out: list[DataFrame] = []
    for length in range(1, longest + 1):
        sieve = _sieve(out[-1].filter("phrase <> ''")) if out else None
        counts = ngram_counts(docs, group, text, length, sieve)
        out.append(materialize(counts.filter((F.col("f") >= least) | (F.col("phrase") == "")), "phrases"))
    return out


def collocations(tables: list[DataFrame], share: int = SHARE, top: int = TOP) -> DataFrame:
    """(grp, rank, phrase, a, l, r, n, score): of the phrases of two words and more in ``tables``, those that no
    longer one stands for (with ``share`` percent of their count), best first."""
    counts = reduce(DataFrame.unionByName, tables).filter("phrase <> ''")
    sized = [t.withColumn("m", F.lit(k)) for k, t in enumerate(tables, 1)]
    several = reduce(DataFrame.unionByName, sized[1:])
    parts = F.split("phrase", " ")
    cut = F.transform(
        F.sequence(F.lit(1), F.col("m") - 1),
        lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(parts, k + 1, F.col("m") - k), " ").alias("rest")),
    )
    cuts = several.select("grp", "phrase", F.col("f").alias("a"), F.explode(cut).alias("c"))
    left = counts.select(F.col("grp").alias("lg"), F.col("phrase").alias("lp"), F.col("f").alias("l"))
    right = counts.select(F.col("grp").alias("rg"), F.col("phrase").alias("rp"), F.col("f").alias("r"))
    met = cuts.join(left, (F.col("grp") == F.col("lg")) & (F.col("c.first") == F.col("lp"))).join(right, (F.col("grp") == F.col("rg")) & (F.col("c.rest") == F.col("rp")))
    score = F.expr(f"cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * {SCALE} div (cast(l as decimal(16,0)) * cast(r as decimal(16,0))) as long)")
    lowest = met.groupBy("grp", "phrase").agg(F.min(F.struct(score.alias("score"), F.col("c.k").alias("k"), "a", "l", "r")).alias("b"))
    # What a longer phrase holds, with the largest count of those that hold it.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("m") - m + 1), lambda at: F.array_join(F.slice(parts, at, m), " "))))
    longer = [t.select("grp", F.col("f").alias("w"), F.explode(inner).alias("phrase")) for t in sized[2:]]
    if longer:
        covers = reduce(DataFrame.unionByName, longer).groupBy(F.col("grp").alias("cg"), F.col("phrase").alias("cp")).agg(F.max("w").alias("w"))
        lowest = lowest.join(covers, (F.col("grp") == F.col("cg")) & (F.col("phrase") == F.col("cp")), "left").filter(F.col("w").isNull() | (F.col("w") * 100 < F.col("b.a") * share))
    best = Window.partitionBy("grp").orderBy(F.desc("b.score"), F.desc("b.a"), "phrase")
    ranked = lowest.select("grp", "phrase", "b", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= top)
    totals = tables[0].filter("phrase = ''").select(F.col("grp").alias("tg"), F.col("f").alias("n"))
    return ranked.join(totals, F.col("grp") == F.col("tg")).select("grp", "rank", "phrase", F.col("b.a").alias("a"), F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tables = frequent_phrases(docs, F.col("lang"), F.col("text"))
    rows = materialize(collocations(tables), "collocations")
    for t in tables:
        release(t)
    return rows.select(F.col("grp").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, {WORDS + 1}) r(m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang, m, phrase, f FROM f WHERE f >= {LEAST}),
cand AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE m >= 2),
cuts AS MATERIALIZED (SELECT *, lang || ':' || array_to_string(w[1 : k], ' ') AS first, lang || ':' || array_to_string(w[k + 1 : m], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
parts AS MATERIALIZED (SELECT lang || ':' || phrase AS part, f FROM often),
scored AS MATERIALIZED (SELECT c.lang, c.m, c.phrase, c.a, c.k, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN parts l ON l.part = c.first JOIN parts r ON r.part = c.rest),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS MATERIALIZED (SELECT lang, a, array_to_string(w[i : i + s - 1], ' ') AS phrase FROM (SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS i FROM cand, range(2, {WORDS}) r(s) WHERE s < m)),
covers AS MATERIALIZED (SELECT lang || ':' || phrase AS part, max(a) AS w FROM inner_ GROUP BY ALL),
left_ AS (SELECT low.* FROM low LEFT JOIN covers c ON c.part = low.lang || ':' || low.phrase WHERE c.w IS NULL OR 100 * c.w < {SHARE} * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= {TOP}
"""

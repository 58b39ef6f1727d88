"""Operator 11: document fingerprints by Order MinHash.

A text is its k-mers of code points, each numbered among its equals.  For each of SLOTS hash functions the PICKED
numbered k-mers with the least hashes are taken, put back into text order, and the tuple of their k-mers is
hashed into one entry of the signature.  Two signatures agree in an entry where the same k-mers are least and stand in
the same order, so their likeness, the share of entries that agree, falls with moved and edited text alike.

``op11_order_minhash`` also compares each document with the next one in descending order of ids.  The documents
are partitioned by ranges of the id, once; a task walks its range in order, with one text in hand, and only the
first and last document of each range meet by a join.

Defined cases: a null text is empty; all empty texts have one fingerprint, of zeros; a text shorter than a k-mer is
one k-mer; fewer than PICKED k-mers are all taken; null ids come last, equal ids in the order of their texts' sha256; a
single document is its own next one; texts are read whole, in blocks for the hashes; an empty table gives an empty
one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from credence.llm.common import materialize, refuse_clash, small_batches, table, worker_state

#: Code points in a k-mer, entries of a signature, k-mers in an entry.
KMER, SLOTS, PICKED = 5, 64, 2
#: K-mers hashed at once.
BLOCK = 4096


def _mixed(x):
    """A bijection of 64-bit numbers that lets every bit depend on every other."""
    import numpy as np

    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """The hash functions of a signature, fixed by its parameters."""

    def __init__(self, kmer: int = KMER, slots: int = SLOTS, picked: int = PICKED):
        import numpy as np

        if min(kmer, slots, picked) < 1:
            raise ValueError("k-mers, slots and picks are one at least")
        self.kmer, self.slots, self.picked = kmer, slots, picked
        self.factors = _mixed(np.arange(1, slots + 1, dtype=np.uint64)) | np.uint64(1)
        self.powers = _mixed(np.arange(1001, 1001 + kmer, dtype=np.uint64)) | np.uint64(1)

    def kmers(self, text: str):
        """A hash of each k-mer of ``text``, in order; and the hash that its number among its equals gives it."""
        import numpy as np

        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        n = max(1, len(points) - self.kmer + 1)
        h = np.zeros(n, np.uint64)
        for k, power in enumerate(self.powers):
            part = points[k : k + n]
            if len(part):  # a text shorter than a k-mer ends before
                h += part.astype(np.uint64) * power
        h = _mixed(h)
        order = np.argsort(h, kind="stable")
        lined = h[order]
        heads = np.flatnonzero(np.concatenate([[True], lined[1:] != lined[:-1]]))
        number = np.empty(n, np.uint64)
        number[order] = np.arange(n, dtype=np.uint64) - np.repeat(heads, np.diff(np.append(heads, n))).astype(np.uint64)
        return h, _mixed(h + number * np.uint64(0x9E3779B97F4A7C15))

    def signature(self, text: str):
        """The entries of a text's signature, 32 bits each."""
        import numpy as np

        h, own = self.kmers(text)
        if not len(h):
            return np.zeros(self.slots, np.uint32)
        # The least hashes so far of each function and where they are, block by block.
        least, where = np.zeros((self.slots, 0), np.uint64), np.zeros((self.slots, 0), np.int64)
        top, rows = np.uint64(0xFFFFFFFFFFFFFFFF), np.arange(self.slots)
        for at in range(0, len(own), BLOCK):
            hashes = np.multiply.outer(self.factors, own[at : at + BLOCK])
            for _ in range(min(self.picked, hashes.shape[1])):
                best = hashes.argmin(axis=1)
                least = np.concatenate([least, hashes[rows, best][:, None]], axis=1)
                where = np.concatenate([where, (best + at)[:, None]], axis=1)
                hashes[rows, best] = top
            if least.shape[1] > self.picked:
                keep = np.argsort(least, axis=1, kind="stable")[:, : self.picked]
                least, where = np.take_along_axis(least, keep, 1), np.take_along_axis(where, keep, 1)
        entry = np.zeros(self.slots, np.uint64)
        for column in np.sort(where, axis=1).T:
            entry = _mixed(entry * np.uint64(0x9E3779B97F4A7C15) + h[column] + np.uint64(1))
        return (entry >> np.uint64(32)).astype(np.uint32)


def packed(signature) -> bytes:
    """A fingerprint: the entries in order, most significant byte first."""
    return signature.astype(">u4").tobytes()


def alike(a, b) -> float:
    return float((a == b).mean())


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """The share of entries in which two columns of fingerprints agree."""
    entry = lambda c, k: F.substr(c, k * 8 + 1, F.lit(8))
    agree = F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: entry(a, k) == entry(b, k))
    return F.size(agree) / slots


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", kmer: int = KMER, slots: int = SLOTS, picked: int = PICKED) -> DataFrame:
    """``docs`` and the fingerprint of each text."""
    refuse_clash(docs, {out})
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sketch = worker_state(f"fingerprints {kmer} {slots} {picked}", lambda: Sketcher(kmer, slots, picked))
        for batch in batches:
            prints = [packed(sketch.signature(t.as_py() or "")).hex() for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], [*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, StringType())]))


OUT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
#: What a task returns: documents that met their next one, and the first and last one of its range, with their texts.
WALKED = f"{OUT}, end string, cell int, text string"


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _met(sketch: Sketcher, doc_id: int | None, text: str, own, after: str, following) -> dict:
    """The row of a document, its next one being ``after`` with the signature ``following``."""
    new = edited(text, after)
    changed = own if new == text else sketch.signature(new)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).digest(), "fingerprint": packed(own),
        "edited_fingerprint": packed(changed), "near_edited": alike(own, changed), "near_next": alike(own, following),
    }


def with_next(docs: DataFrame, kmer: int = KMER, slots: int = SLOTS, picked: int = PICKED) -> DataFrame:
    """The columns of ``op11_order_minhash`` for ``docs`` (doc_id, text), a table or a scan of one."""
    spark = docs.sparkSession
    sketch = lambda: worker_state(f"fingerprints {kmer} {slots} {picked}", lambda: Sketcher(kmer, slots, picked))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("tie")]
    # A number of partitions of our own: few bytes are much work here, so ranges aren't put together by size.
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    schema, finished = (to_arrow_schema(StructType.fromDDL(s)) for s in (WALKED, OUT))

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sketcher, last = sketch(), None
        for batch in batches:
            out = []
            for doc_id, text, cell in zip(*batch.columns):
                now = doc_id.as_py(), text.as_py(), sketcher.signature(text.as_py()), cell.as_py()
                if last is None:
                    out.append({"end": "first", "cell": now[3], "text": now[1]})
                else:
                    out.append(_met(sketcher, *last[:3], now[1], now[2]))
                last = now
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": last[0], "end": "last", "cell": last[3], "text": last[1]}], schema=schema)

    def close(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sketcher = sketch()
        for batch in batches:
            out = [_met(sketcher, r["doc_id"], r["text"], sketcher.signature(r["text"]), r["after"], sketcher.signature(r["after"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=finished)

    walked = materialize(ranged.select("doc_id", "text", F.spark_partition_id().alias("cell")).mapInArrow(walk, WALKED), "walked")
    # One row for each range: its first document is the next one of the last document of the range before.
    cells = walked.filter("end = 'first'").select("cell")
    around = cells.select("cell", F.coalesce(F.lead("cell").over(Window.orderBy("cell")), F.min("cell").over(Window.partitionBy())).alias("then"))
    first = walked.filter("end = 'first'").select(F.col("cell").alias("then"), F.col("text").alias("after"))
    ends = walked.filter("end = 'last'").select("doc_id", "text", "cell").join(around, "cell").join(first, "then")
    closed = ends.select("doc_id", "text", "after").mapInArrow(close, OUT)
    rows = walked.filter("end IS NULL").select(*finished.names).unionByName(closed)
    # Digests are half as long in the table between as they are in text.
    return rows.select(*[F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in rows.dtypes])


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Plumbing shared by the training-data operators: tables, scratch tables, row indexes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that separate words and that exact comparison deletes: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"

_own_root: str | None = None
_live: list[tuple[SparkSession, str]] = []


_worker_state: dict[str, object] = {}


def worker_state(owner: str, make=lambda: True):
    """What a Python worker keeps between tasks.  A worker serves one operator after another: it keeps the
    state of the last owner only, and gives the memory of the one before back to the system."""
    if owner not in _worker_state:
        _worker_state.clear()
        give_back()
        _worker_state[owner] = make()
    return _worker_state[owner]


def give_back() -> None:
    """Free what is no longer referenced, Arrow's pool and the allocator's arenas included."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def give_back_driver(spark: SparkSession) -> None:
    """Free what is no longer referenced in the driver, and give it back to the system: its Python, and its JVM's
    heap and allocator, which otherwise keep what the planning of earlier queries took."""
    give_back()
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    try:  # a JVM may have no such command; the server's own class isn't open to reflection, its interface is
        of, text = jvm.java.lang.Class.forName, "java.lang.String"
        kinds = new_array(jvm.java.lang.Class, 4)
        kinds[0], kinds[1], kinds[2], kinds[3] = of("javax.management.ObjectName"), of(text), of("[Ljava.lang.Object;"), of(f"[L{text};")
        args = new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


#: Rows in one of Spark's Arrow batches; with the default of 10,000 a batch of texts takes over 100 MB, twice while it grows.
ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bound the memory outside of the heap that a task takes for rows on their way to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def refuse_clash(df: DataFrame, added: set[str], but: set[str] = frozenset()) -> None:
    """Operators add columns and never replace one: a column that exists already is an error, in any case of letters."""
    there = {c.lower() for c in df.columns} - {c.lower() for c in but}
    if clash := sorted(c for c in added if c.lower() in there):
        raise ValueError(f"columns {clash} exist already")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by a path that only Spark's readers need to understand."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only in local mode."""
    global _own_root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="credence-scratch-")
    return _own_root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a table in the shared scratch folder and read it back: this cuts the lineage
    and survives the loss of any executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_root(spark)}/credence/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _live.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ours, in whatever store it is."""
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # noqa: BLE001  the session may be gone; leftovers only cost disk
        pass


def release(df: DataFrame | None = None) -> None:
    """Delete one scratch table, or all of them; call it once nothing lazy reads them any more."""
    wanted = getattr(df, "_scratch_path", None) if df is not None else None
    if df is not None and wanted is None:
        return
    for item in list(_live):
        spark, path = item
        if wanted in (None, path):
            _live.remove(item)
            remove(spark, path)


def live() -> set[str]:
    """The scratch tables that are there."""
    return {path for _, path in _live}


def release_paths(paths: set[str]) -> None:
    for item in list(_live):
        if item[1] in paths:
            _live.remove(item)
            remove(*item)


@atexit.register
def _remove_own_root() -> None:
    if _own_root:
        import shutil

        shutil.rmtree(_own_root, ignore_errors=True)


#: Bits in one of Spark's bitmaps, and the most bitmaps in a filter: 16 MB whatever the input.
BITMAP_BITS, MOST_BITMAPS = 32768, 4096


def bitmap_filter(hashes: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(chunk, bits): a bitmap of the hashes in ``column``, about 12 bits for each but never more than
    MOST_BITMAPS chunks; and the number of bits.  It lets through every hash it was made of, and a few
    others (all, once there are far too many: then it saves nothing, and results are the same)."""
    n, chunks = hashes.count(), 1
    while chunks < MOST_BITMAPS and chunks * BITMAP_BITS < 12 * n:
        chunks *= 2
    at = F.pmod(F.col(column), F.lit(chunks * BITMAP_BITS))
    rows = hashes.select(F.floor(at / BITMAP_BITS).cast("int").alias("chunk"), (at % BITMAP_BITS).alias("bit"))
    return rows.groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits")), chunks * BITMAP_BITS


def passes_filter(df: DataFrame, hashed, bitmap: DataFrame, n_bits: int, out: str) -> DataFrame:
    """Add ``out``: whether the filter lets the row's hash through.  The bitmap has a fixed bound, so it
    is broadcast."""
    at = F.pmod(hashed, F.lit(n_bits))
    place, chunk, bits = (fresh(c, df.columns) for c in ("__at", "__chunk", "__bits"))
    right = F.broadcast(bitmap.select(F.col("chunk").alias(chunk), F.col("bits").alias(bits)))
    low = df.withColumn(place, at).join(right, F.floor(F.col(place) / BITMAP_BITS).cast("int") == F.col(chunk), "left")
    bit = F.expr(f"shiftright(cast(conv(hex(substring({bits}, cast(({place} % {BITMAP_BITS}) div 8 as int) + 1, 1)), 16, 10) as int), cast({place} % 8 as int)) & 1")
    return low.withColumn(out, F.coalesce(bit == 1, F.lit(False))).drop(place, chunk, bits)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column is called that."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def with_row_numbers(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that numbers its rows: the id itself where it is a whole number,
    unique and never null; else a new column, in a table of its own, for numbers must not change."""
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    if whole and not docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").limit(1).count():
        return docs, id_col
    number = fresh("__row", docs.columns)
    return materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def without_rows(docs: DataFrame, number: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``number`` is in ``gone`` (one column, read twice).  Rows that a
    bitmap of the numbers doesn't let through stay where they are; the others are joined."""
    gone = gone.toDF("__gone")
    bitmap, n_bits = bitmap_filter(gone.select(F.xxhash64("__gone").alias("h")), "h")
    may = fresh("__may", docs.columns)
    tried = passes_filter(docs, F.xxhash64(F.col(number).cast("long")), bitmap, n_bits, may)
    stay = tried.filter(~F.col(may)).drop(may)
    return stay.unionByName(tried.filter(F.col(may)).drop(may).join(gone, F.col(number) == F.col("__gone"), "left_anti"))


def prefix_cell(md5_col, bits: int):
    """The first ``bits`` (at most 16) of an md5 string, as an int: ranges of the md5 order."""
    return F.floor(F.conv(F.substring(md5_col, 1, 4), 16, 10).cast("long") / F.lit(1 << (16 - bits))).cast("int")


def dense_index(df: DataFrame, group: list[str], key_md5: str, then: list[str], out: str, n_rows: int, cell_rows: int = 100_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of (``key_md5``, *``then``).

    A group may hold any share of the rows: it is cut into ranges of the md5 (cells), numbered
    inside each cell and shifted by the cells before it.  The table of cells has at most
    groups x 4096 rows; rows are shuffled once, on (group, cell).
    """
    bits = min(12, max(6, math.ceil(math.log2(max(1, n_rows / cell_rows)))))
    cell, at, shift, of = (fresh(c, df.columns) for c in ("__cell", "__at", "__shift", "__of"))
    rows = df.withColumn(cell, prefix_cell(F.col(key_md5), bits))
    counts = rows.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*[F.col(g).alias(f"{of}{i}") for i, g in enumerate(group)], F.col(cell).alias(f"{cell}_c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(shift))
    inside = Window.partitionBy(*group, cell).orderBy(key_md5, *then)
    numbered = rows.withColumn(at, F.row_number().over(inside) - 1)
    on = [F.col(g) == F.col(f"{of}{i}") for i, g in enumerate(group)] + [F.col(cell) == F.col(f"{cell}_c")]
    joined = numbered.join(shifts.hint("merge"), on, "inner")
    return joined.select(*df.columns, (F.col(at) + F.col(shift)).cast("long").alias(out))

"""Helpers shared by the corpus operators: the shared work folder and the word rule."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space and TAB, LF, VT, FF, CR.  ``bytes.split()`` cuts at the same six bytes.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Bytes up to which a measured table is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


#: Rows that one row stands for at most before they are unrolled.
RUN = 10_000

#: What an Arrow batch holds at most on its way to a Python worker, unless the session sets its own: whole texts come in
#: few megabytes at a time, however long they are.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once for each application, in case it isn't installed there; bounds the
    batches that they get."""
    for key, (default, most) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, most)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/tideway", "zip", root, "tideway")
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)


def lean(run: Callable) -> Callable:
    """A task function that gives memory back to the system when its task ends: Python workers stay for further tasks, and
    an executor has several that wait."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where the session names none, a local one, but never on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/tideway"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables of one operator run in the shared folder.

    ``save`` writes a DataFrame as Parquet and reads it back, which cuts the lineage at a point that survives
    the loss of any executor.  ``drop`` removes what is no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.root if name == "." else f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Removes all tables of the run; nothing may read them any more."""
        self.drop(".")


def table_bytes(df: DataFrame) -> int:
    """What a saved table takes in memory: its rows times the width of their fixed columns, and the bytes of the others."""
    long = [F.sum(F.octet_length(f.name)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    n, *more = df.agg(F.count("*"), *long).first()
    return n * (24 + 8 * len(df.columns)) + sum(x or 0 for x in more)


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a saved table of scalar columns, with a broadcast hint if its size is within the bound.

    It is measured here, unless the number of its rows, all of fixed width, is given.
    """
    size = table_bytes(df) if rows is None else rows * (24 + 8 * len(df.columns))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def unroll(df: DataFrame, n: str, name: str, rows: int) -> DataFrame:
    """``df`` with each row repeated ``n`` times, numbered from 0; ``rows`` in all.

    A row is cut before it is unrolled: none holds more than RUN numbers, and where there are many, the pieces are dealt
    to all tasks.
    """
    cut = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(RUN).cast("long"))).alias("_from"))
    cut = cut.repartition(int(max(1, min(4096, rows // RUN))), *df.columns, "_from")
    return cut.select(*df.columns, F.explode(F.sequence("_from", F.least(F.col("_from") + RUN, F.col(n)) - 1)).alias(name))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def text_key(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id."""
    return F.xxhash64(text)


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text) is in ``rejected(doc_id, text_key)``, a saved table.

    The text column is shuffled only if the rejected rows are too many to be broadcast.  Columns that ``docs`` has
    besides never meet those of the other table by name.
    """
    keys = rejected.select(F.struct("doc_id", "text_key").alias("rejected")).distinct()
    keys = F.broadcast(keys) if table_bytes(rejected) <= BROADCAST_BYTES else keys
    left, right = docs.alias("l"), keys.alias("r")
    return left.join(right, F.col("r.rejected.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.rejected.text_key") == text_key(F.col("l.text"))), "left_anti")

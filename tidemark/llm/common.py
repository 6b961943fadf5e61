"""What the training-data operators share: reading texts from Arrow batches and the shared scratch folder."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Maps A-Z to a-z and every byte that is no digit, letter or part of a non-ASCII character to a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return column.fill_null("").cast(pa.binary()).to_pylist()


BATCH_BYTES = 4 << 20


def private(df: DataFrame) -> DataFrame:
    """df on a session of its own, a copy of the caller's with its settings: Arrow batches to Python workers are bounded by
    bytes, so memory doesn't follow the length of texts. The caller's session stays as it is."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if spark.conf.get(name) == str(BATCH_BYTES):
        return df
    copy = spark._jsparkSession.cloneSession()
    own = SparkSession(spark.sparkContext, copy)
    own.conf.set(name, str(BATCH_BYTES))
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy, df._jdf.queryExecution().analyzed()), own)


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores behind it as make it differ from all taken ones."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators need, so extra columns of any name do no harm; see private()."""
    return private(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor shares; removed when the driver's JVM ends.

    Only where that setting is absent and Spark runs in one process (tests) a folder of this machine stands in for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    folder, files = _hadoop(spark, path)
    files.deleteOnExit(folder)
    return path


def _hadoop(spark: SparkSession, path: str) -> tuple:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes the folders of stored() tables that nothing reads any more."""
    for table in tables:
        if table is not None and getattr(table, "scratch", None):
            folder, files = _hadoop(table.sparkSession, table.scratch)
            files.delete(folder, True)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


_kept: dict[str, Callable[[], None]] = {}  # by module: empties what it keeps in this process between tasks
_last = ""  # module of the operator that ran last in this process


def keeps(module: str, empty: Callable[[], None]) -> None:
    """Says what empties the tables that a module keeps in a Python worker from one of its tasks to the next; see tidy()."""
    _kept[module] = empty


def trim() -> None:
    """Gives the memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if give_back:
            give_back(0)


def taken_over(module: str) -> None:
    """This process now works for a module: what others keep in it goes."""
    global _last
    if module == _last:
        return
    _last = module
    for name, empty in _kept.items():
        if name != module:
            empty()
    trim()


def tidy(run: Run) -> Run:
    """run, after which a Python worker gives the memory it has freed back to the system: workers outlive their tasks. They also
    go from one operator to the next, so what others keep goes first: a worker holds the tables of one operator at a time."""
    module = run.__module__

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken_over(module)
        yield from run(batches)
        trim()

    return tidied


def spans_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs with these lengths, the total last."""
    return np.concatenate(([0], np.cumsum(lengths)))


def pieces(batch: pa.RecordBatch, most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text, a row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes + 64)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield batch.slice(first, last - first)
        first = last


_SPACE = re.compile(rb"[ \t-\r]")


def word_lists(raw: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased, in lists of about `most` bytes: memory stays bounded."""
    if len(raw) <= most:
        yield raw.lower().split()
        return
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, min(at + most, len(raw)))
        end = cut.start() if cut else len(raw)
        yield raw[at:end].lower().split()
        at = end


def fold_of(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; 0 where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % k, F.lit(0))


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, unless PYTHONPATH already does; once for each Spark context."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_tidemark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")  # Spark serves it from here to the executors
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.glob("tidemark/**/*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    context._tidemark_shipped = True

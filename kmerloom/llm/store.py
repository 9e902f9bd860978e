"""Shared storage for intermediate tables, and release of what they replaced."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (as in tests) gets a folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="kmerloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows in an Arrow batch of what is run inside; for plans whose rows are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Hadoop starts a process (chmod) for every file and folder that it makes on a mounted disk, and until such a process
#: runs it counts with all of the memory of the executor or driver that starts it.  So a table has no files beside its
#: parts: no mark of success, as a write that fails raises, and no checksums of files, as Parquet's pages have their own.
PARTS_ONLY = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "parquet.page.write-checksum.enabled": "true",
}
CHECKED = {"parquet.page.verify-checksum.enabled": "true"}

DOCUMENT_ROWS = 1000  # of an Arrow batch while tables are written: their rows may be whole documents


class Scratch:
    """Tables written as zstd Parquet in the shared folder; each cuts the lineage of what follows.

    A lost executor costs only the tasks that ran on it, as the tables outlive it.
    The folder goes with ``drop()`` of its tables or at the end of the driver.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.dir, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._end)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.dir}/{self.n}"
        with batch_rows(self.spark, DOCUMENT_ROWS):
            df.write.options(compression="zstd", **PARTS_ONLY).parquet(path)
        out = self.spark.read.schema(df.schema).options(**CHECKED).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            fs, at = _filesystem(self.spark, t._scratch_path)
            fs.delete(at, True)

    def reclaim(self) -> None:
        """Lets Spark remove the shuffle files of plans that no one holds any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _end(self) -> None:
        try:
            fs, at = _filesystem(self.spark, self.dir)
            fs.delete(at, True)
        except Exception:  # noqa: BLE001  the session is gone, and the folder with it or not
            return

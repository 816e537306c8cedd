"""What every operator needs from the session: shared scratch tables, Arrow batch bounds, code on the executors."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
#: Bytes of one Arrow batch handed to Python; bounds a worker's memory whatever the length of the texts.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches (a smaller bound of the caller stays) and make this package importable on executors that don't share the driver's path."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(bound)
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    sc = spark.sparkContext
    on_path = {os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    if str(ROOT) not in on_path and not getattr(sc, "_blockloom_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix="blockloom-")) / "blockloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in (ROOT / "blockloom").rglob("*.py"):
                z.write(f, f.relative_to(ROOT))
        sc.addPyFile(str(archive))
        sc._blockloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, or the one given to setCheckpointDir; a local one only in local mode."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not (own := getattr(sc, "_blockloom_scratch", None)):
        own = sc._blockloom_scratch = tempfile.mkdtemp(prefix="blockloom-scratch-")
    return own


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind: Spark removes them at the end of each execution."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs only a re-read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = prepare(spark)
        self.base = f"{shared_dir(spark).rstrip('/')}/blockloom-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._blockloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._blockloom_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lean() -> None:
    """In a Python worker: what Arrow and the allocator hold but don't use goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: sizes work by the data, not by a setting."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def crc_mod(col: str, m: int):
    """crc32 of an id's decimal text, modulo m."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(m))


def with_row(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with _row, a long that no two rows share: the doc_id, or a number in a kept table where ids repeat or are null."""
    ids = docs.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    if (ids["most"] or 0) <= 1 and not ids["nulls"]:
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    return scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()))

"""Helpers shared by the corpus operators: text columns, tables in the shared folder, stable hashes."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a session on one machine (tests, notebooks) may leave
    it unset and gets a folder of its own; on a cluster that would be a folder that executors can't see.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="metricloom-")
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/metricloom/{spark.sparkContext.applicationId}"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Jobs run in here remove their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: this cuts the lineage,
    survives the loss of executors and gives Spark true sizes to plan joins with. What was shuffled to
    make it is removed as soon as it is written. The table stays until :func:`release` or :func:`clear`."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` from which nothing is read any more."""
    for df in tables:
        own = f"/metricloom/{df.sparkSession.sparkContext.applicationId}/"
        for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if own in path:
                _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete every table that this session's operators have written to the shared folder; results that have
    not been read yet are gone then."""
    _delete(spark, _own_dir(spark))


def slices(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most``, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc(column: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def crc_of(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(blob: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case: bytes.split() cuts at exactly these."""
    return blob.lower().split()


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)

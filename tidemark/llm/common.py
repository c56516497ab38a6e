"""What the operators share: tables, a staging folder that every executor sees, whole-text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.  ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: The same as a Java pattern in a SQL literal.
JAVA_WORD = r"[^ \u0009-\u000D]+"

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Arrow batches are kept small, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and Spark runs in one process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidemark-")
    return "file://" + _own[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage as a checkpoint does, in compressed columns: a lost executor costs no recomputation,
    and an expression that is used twice is evaluated once.  The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text) -> "F.Column":
    """Number of words of a text column, 0 for null; evaluated in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(JAVA_WORD)), F.lit(0)).cast("long")


def pieces_of(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches by bytes, so that what NumPy builds from one stays bounded.  A row is never cut."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, n * most // max(batch.nbytes, most))
        for a in range(0, n, step):
            yield batch.slice(a, step)
        # workers live on from stage to stage
        pa.default_memory_pool().release_unused()

"""What the operators of this subpackage share: shared storage, row identity, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words between ASCII white space, for regexp functions.
SPACED_WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    It is the session's ``spark.checkpoint.dir``. Only a local session may run without one; it
    then gets a temporary folder. A cluster session without it is an error, since a folder of one
    machine would lose its files with that machine.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quirekit-"))
    return sc.getCheckpointDir().rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark delete shuffle files that only the written plan needed
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`store` wrote; for tables that nothing reads from here on."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def training_row(doc_id: Column, folds: int) -> Column:
    """True outside the held-out fold: crc32 of the id's text, modulo ``folds``, is not 0 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != 0


def slices(batches: Iterable, rows: int = 512) -> Iterator:
    """Arrow batches in pieces of at most ``rows`` rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

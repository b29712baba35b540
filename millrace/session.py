"""Session helpers shared by every part of the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read lazily so that pruning and pushdown reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset, one of our own.

    Executors can be lost, so lineage is only ever cut by files in this folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if named is None:
        current = jsc.getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="millrace-checkpoint-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Rows, of a few numbers each, that make a file.
ROWS_A_FILE = 50_000


def few_files(df: DataFrame, rows: int | None) -> DataFrame:
    """df in partitions for about so many narrow rows: a small table is settled in few files, however many partitions its shuffle had. As it is if rows is None."""
    return df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle of both sides: for rows that grow with the input, whose size the optimizer guesses from that of compressed files and so may broadcast through the driver."""
    return df.hint("merge")


def settle(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared folder: later uses read files, not lineage. release() deletes them."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _written.append((df.sparkSession, file.get()))
    return out


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which release() deletes."""
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settle_table(df: DataFrame) -> DataFrame:
    """As settle(), in compressed columnar form; for wide or repetitive rows."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


_written: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete what was written to shared paths; call once the results that read it are stored."""
    while _written:
        spark, path = _written.pop()
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

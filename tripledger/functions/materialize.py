"""Cut a plan at a table that several branches read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session in one process (local master) gets a folder of its own; on a cluster a
    machine-local folder would lose rows, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tripledger-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed by the file system client when the session's process ends."""
    path = f"{shared_folder(spark)}/tripledger-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that no reader needs any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write the table once to the shared folder and read it back.

    A written table survives the loss of executors, has no lineage, keeps column pruning and
    gives the optimizer its real size for later join choices. The shuffle files behind it are removed as
    soon as it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame, kept: Sequence[DataFrame] = ()) -> None:
    """Remove the written tables that these ones read, once what was made of them is written and nothing reads them any more.

    kept: tables whose files stay.
    """
    folders = lambda some: {(t.sparkSession, file.rsplit("/", 1)[0]) for t in some for file in t.inputFiles()}
    for spark, folder in folders(tables) - folders(kept):
        if folder.rsplit("/", 1)[1].startswith("tripledger-"):
            discard(spark, folder)


#: Rows of the largest table that one slice takes.
SLICE = 4_000_000


def by_slices(step: Callable[..., DataFrame], keys: Sequence[str], *tables: DataFrame) -> DataFrame:
    """``step(*tables)`` over slices of the rows by a hash of the keys, one after the other, each result written.

    Every join and group of the step holds the keys, so no row meets one of another slice and the rows are those of
    one step over all. The shuffle files and inner tables on disk at a time are those of one slice, however many rows there are.
    Tables of up to SLICE rows are one slice, which is not written. The tables are written ones, and the step reads no others.
    """
    number = -(-max(t.count() for t in tables) // SLICE)
    if number <= 1:
        return step(*tables)
    place, parts = F.pmod(F.xxhash64(*keys), F.lit(number)), []
    for i in range(number):
        found = step(*[t.filter(place == i) for t in tables])
        parts.append(materialize(found))
        release(found, kept=tables)
    return reduce(DataFrame.unionByName, parts)


def multiplied(df: DataFrame) -> DataFrame:
    """Rows that an explode has multiplied, for a join by shuffle at every size.

    Spark's estimate does not count the added rows and would send them whole through the driver.
    """
    return df.hint("merge")


def grown(df: DataFrame) -> DataFrame:
    """Rows whose number grows with the input, for a join by shuffle at every size.

    Where many such tables meet in one query, each just small enough to broadcast, they would fill the driver together.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly over spark.sql.shuffle.partitions before CPU-heavy row work, at every size.

    The rows are few bytes next to the work on them, and neither one large file nor small ones then decide
    how many tasks share it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

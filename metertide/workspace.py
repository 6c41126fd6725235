"""Intermediate tables in the folder that all executors share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written, and tables named, within ``temporary_tables`` blocks, the innermost block's last.
_written: list[list[str]] = []
_named: list[list[str]] = []


def is_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` has executors of its own."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which must be one that all executors see.

    Without that setting a local session gets a temporary folder. On a cluster no machine-local
    folder would do, so there it is an error. Whether a ``file:`` folder is a mount that all machines
    share cannot be told from its name, so it is taken as it is.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not is_one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="metertide-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/metertide/{app}/{name}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    return path


def new_table() -> str:
    """A name for the catalog, taken back at the end of a ``temporary_tables`` block."""
    table = f"metertide_{uuid.uuid4().hex}"
    if _named:
        _named[-1].append(table)
    return table


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table.

    Later jobs start from files instead of from the whole lineage, survive the loss of executors,
    and still prune columns and push filters, which a checkpointed row RDD would not.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by_key(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """As ``materialize``, in buckets by ``key``: joins and groups by it need no shuffle again.

    There are as many buckets as shuffle partitions, so a ``df`` that is already dealt out by ``key``
    gives about one file per task.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = new_table()
    df.write.bucketBy(buckets, key).sortBy(key, order).saveAsTable(table, format="parquet", path=path)
    return spark.table(table)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written in the block are removed at its end, also after an error, and with
    them their names in the catalog.

    Results must be written elsewhere, or collected, before the block is left.
    """
    _written.append([])
    _named.append([])
    try:
        yield
    finally:
        for table in _named.pop():
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in _written.pop():
            delete(spark, path)

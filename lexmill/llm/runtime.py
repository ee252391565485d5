"""Shared plumbing: scratch tables in the cluster's shared folder and digests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests, a laptop) is a local
    folder set; a cluster must name a folder that its executors see.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
    return context.getCheckpointDir()


#: Folders written by ``staged`` and not yet dropped.
_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; ``drop_staged`` deletes what is written there."""
    path = f"{scratch_root(spark).rstrip('/')}/lexmill/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def drop_staged(spark: SparkSession) -> None:
    """Delete the scratch tables written so far; results that still read them must be written before."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back.

    Cuts lineage, so a lost executor costs a reread instead of a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, compression: str = "zstd") -> DataFrame:
    """``staged``, dealt by ``key`` into as many buckets as a shuffle has partitions: joins on the
    key then move the other side only."""
    spark = df.sparkSession
    table_name = f"lexmill_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    out = df.write.bucketBy(shuffle_width(spark), key).option("path", scratch_path(spark, name)).option("compression", compression)
    out.format("parquet").saveAsTable(table_name)
    return spark.table(table_name)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small iterative table."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

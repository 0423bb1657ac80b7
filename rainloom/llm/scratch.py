"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage and survives the loss of any executor.  The folder is the one
the cluster names in ``spark.checkpoint.dir``; only a local session without that setting (tests, a
laptop) gets a temporary folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: the session's ``spark.checkpoint.dir``, else one set here once.

    A cluster without that setting has no folder that all its machines see: that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="rainloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rainloom-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders ``by`` columns if any, and return it as read from there."""
    path = _path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_each(tables: Iterable[DataFrame], name: str) -> DataFrame:
    """Write tables of one schema, one after the other, as one table and return it as read from there."""
    path = ""
    for table in tables:
        path = path or _path(table.sparkSession, name)
        table.write.mode("append").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing reads any more; what was derived from them must have been kept."""
    for table in tables:
        spark = table.sparkSession
        conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in {re.sub(r"(/rainloom-[^/]*)/.*", r"\1", f) for f in table.inputFiles()}:
            path = hadoop(folder)
            path.getFileSystem(conf).delete(path, True)

"""Where shared intermediate tables live.

They are Parquet under ``spark.checkpoint.dir``, which driver and executors share, so a
lost executor costs a re-read and not a recomputation of an iterative plan.  A table that
no later plan reads is deleted by ``discard``; what the final result is read from stays
under ``<shared folder>/edgeloom/<application id>`` until the owner of the folder removes it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a session whose executors are threads of the driver
    may do without one: it gets an own folder, any other raises ``ValueError``."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master is {master})")
        where = getattr(spark, "_edgeloom_dir", None) or f"file://{tempfile.mkdtemp(prefix='edgeloom-')}"
        spark._edgeloom_dir = where
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/edgeloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the copy."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._edgeloom_path = path
    return out


#: Whether shuffle files go when a query ends; else they stay until the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``written``, for tables whose columns pack well: the reader is ``weighed``.  The shuffle files of the write go with its end."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        copy = written(df, name)
    finally:
        conf.set(CLEAN, before)
    out = weighed(copy)
    out._edgeloom_path = copy._edgeloom_path
    return out


def weighed(df: DataFrame) -> DataFrame:
    """``df``, a reader of Parquet files, kept out of broadcasts if its rows are larger than Spark's threshold.

    Spark takes the length of the files for the size of the rows.  Graph ids and node numbers are packed to a
    byte or two a row, so it would gather tables of millions of rows on the driver.  Rows are counted from the footers.
    """
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df.hint("merge") if most >= 0 and df.count() * (8 + df._jdf.schema().defaultSize()) > most else df


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_edgeloom_path", None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

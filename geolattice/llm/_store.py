"""Tables kept in the folder that all executors share.

Lineage is cut by writing Parquet there and reading it again: a lost executor costs
nothing that was written, and the planner knows the size of what it reads.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="geolattice-"))
    return spark.conf.get("spark.checkpoint.dir")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and return it as a table read from there.

    The files are deleted when the application ends, or by forget().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_at = where
    return table


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables from keep() that nothing will read again; other tables are left alone."""
    for table in tables:
        if where := getattr(table, "kept_at", None):
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands rows to Python workers by 16 MB at a time, not by Spark's 64; long texts would else take several times that outside of the heap. Another setting of the session's own stays."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name, None) == "67108864b":
        conf.set(name, "16m")
    return df


def shipped(spark: SparkSession, value):
    """A broadcast of value, pickled with its classes, so that workers need no copy of this package; the result, called there, gives it."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Column names that don't clash, whatever the case, with those taken."""
    low, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

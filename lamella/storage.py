"""Tables written once and read several times: in the folder that every executor shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on one machine (tests), a temporary one. On a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lamella-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/lamella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lamella_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished queries, which it does when the driver collects its garbage.
    What the driver's compiler and compression have freed goes back to the machine; the C library would keep it."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Have the driver's JVM return its free native memory; False where it can't (before Java 17.0.9, or without glibc)."""
    jvm = spark._jvm
    # The server's class is in no exported package, so the call goes by its interface.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    arguments = spark.sparkContext._gateway.new_array(jvm.Object, 4)
    arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JJavaError:
        return False
    return True


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._lamella_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

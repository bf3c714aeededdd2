"""Shared storage for intermediate tables.

Everything an operator needs to cut lineage or to read twice is written as
Parquet below the folder the cluster names in ``spark.checkpoint.dir``.  Where
that setting is absent a local master (as in tests) has a temporary folder, and
any other is refused: its executors would each write to a disk of their own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("corpusloom.shared.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
            spark.conf.set("corpusloom.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table."""
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as a compressed table and read back: recomputed never, lost never."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    before = spark.conf.get(_CLEANED, "false")
    # the table stands for its plan from here on: the shuffle files that made it go as soon as it is written
    spark.conf.set(_CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no live plan reads; they go when the driver's garbage does.

    What planning and compiling have left in the driver's own memory, heap and other, goes back to the system.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """Give back native memory that the driver has freed, which is some hundreds of MB after many plans; false where its JVM cannot."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    array = lambda kind, *each: _filled(gateway.new_array(kind, len(each)), each)
    try:
        names, name = jvm.java.lang.Class.forName("[Ljava.lang.String;"), jvm.java.lang.Class.forName("java.lang.String")
        several, named = jvm.java.lang.Class.forName("[Ljava.lang.Object;"), jvm.java.lang.Class.forName("javax.management.ObjectName")
        # the server's own class is not open to reflection, its interface is
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, named, name, several, names))
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args = array(jvm.java.lang.Object, command, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String))
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def _filled(array, each):
    for i, x in enumerate(each):
        array[i] = x
    return array

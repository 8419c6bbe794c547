"""Tables that all executors can read: the folder of spark.checkpoint.dir."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; where none is set, a local one, which only a local master can share."""
    found = spark.conf.get(KEY, None)
    if found:
        return found
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"{KEY} must name a folder that all executors of {master} share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # No marker file: on a local folder its mode is set by a process that the driver forks, with all its memory.
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_under = path
    return out


def discard(spark: SparkSession, *frames: DataFrame | str) -> None:
    """Delete what stored() wrote, or tables by name, once nothing unwritten depends on it."""
    for frame in frames:
        if isinstance(frame, str):
            spark.sql(f"DROP TABLE IF EXISTS {frame}")
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.stored_under)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """After a large shuffle: its files go now, not at the driver's next garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str:
    """Hand native memory that the driver's JVM has freed back to the system; what the JVM says of it, or "" where it can't.

    Compilers, codecs and hundreds of short-lived threads allocate natively; the
    allocator keeps what they free, which no garbage collection returns.
    """
    jvm = spark.sparkContext._jvm
    args = spark.sparkContext._gateway.new_array(jvm.Object, 4)
    try:
        # By reflection, as the server's own class is in a package that is not exported.
        bean = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection")
        invoke = next(m for m in bean.getMethods() if m.getName() == "invoke")
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        return str(invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    except Py4JError:  # not this JVM or system
        return ""


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: rows hold whole texts, which may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))

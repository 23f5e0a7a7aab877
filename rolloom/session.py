"""Session helpers shared by every part of the library."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
from collections.abc import Iterator
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

ROWS_OF_A_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 4000
#: Share of the driver's largest heap beyond which it is shrunk between steps.
HEAP_SHARE = 0.4
#: Least and largest percentage of the heap that is free after it has been shrunk (Java's own are 40 and 70).
FREE = {"MinHeapFreeRatio": 10, "MaxHeapFreeRatio": 30}
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and make checkpoint() usable.

    The folder for checkpoints is the one the cluster names in
    ``spark.checkpoint.dir``. Where that is unset, a temporary folder is used if all of
    Spark runs in this process (tests, a laptop); on a cluster that is an error, since
    executors could not share the folder. Batches for Python hold at most
    ``BATCH_ROWS`` rows where the session has Spark's own default, so that a worker's memory
    stays small with long texts.
    """
    sc = spark.sparkContext
    if spark.conf.get(ROWS_OF_A_BATCH) == "10000":
        spark.conf.set(ROWS_OF_A_BATCH, str(BATCH_ROWS))
    known = sc.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        sc.environment["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rolloom-checkpoint-"))
    return spark


@contextlib.contextmanager
def _little_free(jvm) -> Iterator[None]:
    """Collections in here leave little of the heap free; Java's own settings hold again afterwards."""
    kept = {}
    try:
        with contextlib.suppress(Py4JError):  # another Java than HotSpot
            bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
            for name, share in FREE.items():
                kept[name] = bean.getVMOption(name).getValue()
                bean.setVMOption(name, str(min(share, int(kept[name]))))
        yield
    finally:
        with contextlib.suppress(Py4JError):
            for name in reversed(kept):
                bean.setVMOption(name, kept[name])


def _trim(spark: SparkSession) -> None:
    """Gives what Java has freed outside its heap back to the system, where its version has the command."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and broadcasts of steps that are done; the driver's memory shrinks to little more than what is in use."""
    gc.collect()
    with _little_free(spark.sparkContext._jvm):
        spark.sparkContext._jvm.System.gc()
    _trim(spark)


def relieve(spark: SparkSession) -> None:
    """``release`` where the driver's heap has grown beyond ``HEAP_SHARE`` of its limit: many small steps make Java take all it may, and it gives nothing back by itself."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        release(spark)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    prepare(df.sparkSession)
    relieve(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

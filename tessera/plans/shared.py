"""Tables that cut lineage, kept in the folder every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[str] = []
_homes: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Whether Spark deletes a query's shuffle files when it ends; else they lie until the driver's memory is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset on one
    machine (tests), a temporary folder of this process that goes at exit. On a
    cluster, whose executors would not see that, an unset folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder of the shared one, for files of this process."""
    home = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    _written.append(home)
    return f"{home}/{tag}"


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    What follows depends on the files only, so a lost executor costs its own
    tasks, not the plan above; the files' size also gives the optimiser real
    statistics for its choice of join.
    """
    spark = df.sparkSession
    path = folder(spark, tag)
    home, before = _written[-1], spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # nothing reads this write's shuffles again
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _homes[out] = home
    return out


def _delete(spark: SparkSession, home: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` gave and that nothing will read again, results not yet written among them."""
    for df in tables:
        if home := _homes.pop(df, None):
            _written.remove(home)
            _delete(df.sparkSession, home)


def over_cores(df: DataFrame) -> DataFrame:
    """``df`` for work that costs far more than moving its rows: a table that
    lies in fewer pieces than there are cores (one small file, say) is dealt
    over them; any larger one stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def release(spark: SparkSession) -> int:
    """Deletes the tables that this process has written so far; how many there
    were. To be called when results that read them have been written out."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n

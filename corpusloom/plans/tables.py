"""Tables in the cluster's shared folder, which cut the lineage of long plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (local tests) a folder of this process stands in.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="corpusloom-")
    return "file://" + _own["dir"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder. One that is read by fewer tasks than there are cores (one row group, say) is dealt over all of them."""
    rows, cores = spark.read.parquet(f"{folder}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def stage(df: DataFrame, label: str, compression: str = "zstd", sweep: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    A lost executor then costs a reread, not the work before. Tables are removed
    by :func:`unstage`, or when the process ends. With ``sweep`` the driver drops
    its garbage, so that the shuffle files of the work before go from the
    executors' disks; it is for stages behind large shuffles.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if sweep:
        spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    _made[path] = spark
    table.staged_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unstage(*tables: DataFrame) -> None:
    """Deletes tables that :func:`stage` returned; whatever still reads them ends."""
    for table in tables:
        path = table.staged_path
        _delete(_made.pop(path), path)


def remove_staged() -> None:
    """Deletes all tables that :func:`stage` wrote; results that read them end."""
    while _made:
        path, spark = _made.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at the process's end
            pass


atexit.register(remove_staged)

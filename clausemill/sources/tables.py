"""Table access and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`; the scan prunes columns and pushes filters by itself."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session. Only a session that runs on one machine may leave it unset, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_clausemill_dir", None)
    if own is None:
        own = spark._clausemill_dir = "file://" + tempfile.mkdtemp(prefix="clausemill_")
    return own


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder, as a URI, for files that tasks write and other tasks read; it stays until `drop_folder`, `drop_staged` or the driver's end."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}")
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    path = system.makeQualified(hadoop).toUri().toString()
    _made.append((spark, path))
    system.mkdirs(hadoop)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Drop a folder of `shared_folder` that nothing reads any more."""
    _made.remove((spark, path))
    _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already
        pass


@atexit.register
def drop_staged() -> None:
    """Drop every staged table: at the end of the program by itself, earlier when all results made so far have been read or written."""
    while _made:
        _drop(*_made.pop())


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors; the files stay until `drop_staged`, or until the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

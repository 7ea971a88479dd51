"""Reading tables and keeping intermediate ones in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many partitions as there are cores, if its scan has fewer: a small file of one row group is else read and worked on by one core."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def lean(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of so many rows, where the session has Spark's default of 10,000: whole texts are long, and several copies of a batch are alive at once.

    The setting stays, as lazy results are computed later; any other value that the caller has set is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Where that is unset, a folder below the warehouse, which is shared too, or with a local master one of this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None:
            own = tempfile.mkdtemp(prefix="tidemark-") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_tidemark"
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A path below the shared folder whose files go when the driver ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back, so that several readers don't compute it again.

    A lost executor then costs a reread, not a recomputation. The files go when the driver ends, or with release().
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._tidemark_path = path
    return made


def release(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    remove(df.sparkSession, df._tidemark_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone before the driver's Python is
        return

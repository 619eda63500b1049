"""Settings shared by iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a temporary folder does in one process; executors of
    a cluster would not see it, so there RuntimeError is raised."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="mosaiq-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, so that loops have short lineage and survive lost executors. A plain
    checkpoint keeps the constraints of the plan before it, which double in each round of a loop of joins."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)

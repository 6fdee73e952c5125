"""Tables that a plan reads more than once, written once into the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``; a session with a local master gets a temporary one if there is none. A written table cuts the
lineage and survives lost executors; later joins shuffle it by themselves, so that a hot key can be split at run time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Write options for tables in a local folder (other stores ignore them). Hadoop's default there starts chmod for each file and
#: its checksum file; a process that is being started shares the executor's whole memory, so that is counted twice.
NO_CHILDREN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="passage-engine-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get()
    return f"{base.rstrip('/')}/pinned-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return that table."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**NO_CHILDREN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_pinned(spark: SparkSession) -> None:
    """Delete all tables pinned by this application; results that still read them must be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

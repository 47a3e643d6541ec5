"""Tables written to the folder that driver and executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset a local session gets a
    temporary one; on a cluster that is an error, as executors couldn't read the driver's folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="twinspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def place(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the application ends."""
    app = f"{shared_dir(spark).rstrip('/')}/twinspark-{spark.sparkContext.applicationId}"
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(app)
    top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(top)
    return f"{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back. `rows` of a file at most, where rows are large: Parquet looks at
    sizes after every hundredth row only, so a file's rows are held in memory, both as it is written and as it is read."""
    path = place(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

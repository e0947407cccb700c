"""Tables that steps hand on through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A machine-local folder is used only where the session names none and runs in local mode, as in tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="linkloom-")
    return _OWN["dir"]


#: The folder of this process where the session names none.
_OWN: dict[str, str] = {}


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost nothing that came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/linkloom/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by ``materialize`` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/linkloom/" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

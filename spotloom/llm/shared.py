"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a local session gets a temporary folder of its own;
    a cluster, whose machines would not see one, gets an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is written: shuffle files go as soon as the query that made them ends, as nothing reads them again, and
#: Python workers get their rows in smaller batches than by default.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextlib.contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later reads survive lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with _writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(*tables: DataFrame) -> None:
    """Delete tables made by save() that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

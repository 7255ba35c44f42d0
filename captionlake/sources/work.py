"""Work tables between the steps of a plan: written to the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only on a local master without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="captionlake-")


#: Bytes of an Arrow batch between Spark and Python: texts are long, and several batches are in memory at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, unless the session sets a size of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in {k for k, _ in spark.sparkContext.getConf().getAll()}:
        spark.conf.set(name, str(BATCH_BYTES))


class Work:
    """The tables of one plan. A lost executor costs a read, not the steps before; release() when the result is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/captionlake-work-{uuid.uuid4().hex}", []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{name}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.paths.clear()

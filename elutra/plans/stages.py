"""Stage boundaries: tables kept between stages, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stages-"))
    return context._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of an iteration, each written to the shared folder and read back. Those of rounds before the last are removed.

    A checkpoint would carry the estimated size of its plan on; joins multiply such sizes, so that after some
    dozen rounds they would have millions of digits. A table that is read has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{self.n}")
        self.n += 1
        return self.spark.read.parquet(f"{self.folder}/{self.n - 1}")

    def forget(self, last: int = 1) -> None:
        """Removes all but the ``last`` tables."""
        for k in range(max(0, self.n - last)):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{k}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

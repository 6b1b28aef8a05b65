"""Intermediate tables of a job, kept in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelloom.session import fresh_path


BATCH_ROWS = 500
BATCH_BYTES = 2 << 20
SCAN_ROWS = 512
ROW_GROUP = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows are whole texts or their hashes, so batches hold few of them.

    A Python worker and its executor keep several Arrow batches each, a scan one of its own on the heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


class Stages:
    """Parquet copies of intermediate results.

    A stage cuts the lineage: whatever reads it again, also after an executor
    was lost, scans files instead of repeating the work.  ``drop`` removes the
    files once nothing reads them any more.
    """

    def __init__(self, spark: SparkSession, stem: str):
        self.spark = spark
        small_batches(spark)
        self.root = fresh_path(spark, stem)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # A task that writes holds one row group.
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

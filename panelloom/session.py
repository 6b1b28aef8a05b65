"""Session set-up and the one place that knows where shared files may go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on.  Everything about sizing (memory, executors,
# shuffle partitions on a cluster) is left to the deployment.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Panels partitioned by entity join on (entity, period) without a new shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(app: str = "panelloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the required settings; ``conf`` overrides or adds any."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a folder below its warehouse; anywhere else a
    machine-local folder would be lost with its executor, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this application owns."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, stem: str) -> str:
    """A path in the application's folder that no earlier call has used."""
    return f"{run_folder(spark)}/{stem}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, stem: str) -> DataFrame:
    """The frame written to the application's folder and read back.

    For results that several passes read: the plan above runs once, and lost
    executors cost a scan of the stage instead of a rebuild.
    """
    path = fresh_path(spark, stem)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all stages of this application; call it when no result reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

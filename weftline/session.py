"""Session defaults and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_RUN = f"weftline-{uuid.uuid4().hex}"


def local_session(cpus: int | str = "*", memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("weftline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return context.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, name: str, letters: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Later steps then restart from files, so a lost executor costs no recomputation of
    earlier rounds and the plans of iterative steps stay short. Tables that are mostly
    `letters` of sequences are written with a codec that makes them small.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{_RUN}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", "zstd") if letters else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Remove what this process has written with `materialise`; results read from it end too."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/{_RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by `keys` over all shuffle partitions.

    Grouped Python work costs far more than its bytes suggest, so the partition count is
    stated rather than left to size-based merging; the grouping reuses the shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

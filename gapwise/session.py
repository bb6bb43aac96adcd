"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "gapwise", memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Only a local session may fall back to a temp folder."""
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    current = context.getCheckpointDir()
    if current is None:
        if not configured:
            if not context.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
            configured = tempfile.mkdtemp(prefix="gapwise-")
        context.setCheckpointDir(configured)
    return configured or current


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Number of partitions for work of known size: every core gets some, and none gets too much."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


@dataclass(frozen=True)
class StagedTable:
    """A table written once to the shared folder. ``drop`` removes it when a later one has replaced it."""
    frame: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.frame.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_stage(df: DataFrame, label: str) -> StagedTable:
    """Write ``df`` once to the shared folder and read it back.

    The copy ends the lineage (a lost executor re-reads files instead of re-running the past) and
    stays columnar, so later passes read only the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return StagedTable(spark.read.schema(df.schema).parquet(path), path)


def stage(df: DataFrame, label: str) -> DataFrame:
    return write_stage(df, label).frame

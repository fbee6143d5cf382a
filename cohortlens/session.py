"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "cohortlens") -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COHORTLENS_HEAP", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_LOCAL_DIRS: dict[str, str] = {}
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables and model checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back
    to a temporary folder: on a cluster the executors could not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="cohortlens-")
    return _LOCAL_DIRS[context.applicationId]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point iterative learners at the shared folder so they can cut their lineage."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def stage(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    The written table survives lost executors, cuts the lineage, and carries true file
    sizes, so Spark decides on broadcasting from a measured size. ``drop_shuffles`` has Spark
    delete the shuffle files of the write when it has ended, not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_DROP_SHUFFLES, None)
    if drop_shuffles:
        spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)

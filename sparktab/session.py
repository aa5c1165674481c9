"""Session helpers: settings the operators rely on and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sparktab", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC timestamps, AQE with skew handling, and any extra settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.scheduler.mode": "FAIR",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_dir_is_set(spark: SparkSession) -> bool:
    return spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one folder for each application of a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{tempfile.gettempdir()}/sparktab-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not _checkpoint_dir_is_set(spark):
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_checkpoints(spark: SparkSession) -> bool:
    """Set the checkpoint folder where there is one; False where a cluster has none."""
    try:
        ensure_checkpoint_dir(spark)
    except RuntimeError:
        return False
    return True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage so later plans start from files, not from its history."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

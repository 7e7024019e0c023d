"""Sessions, settings and the shared folder for cut lineage."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


@dataclass(frozen=True)
class Settings:
    """Run-time options; every field may be given as ``spark.deedloom.<field>`` or ``DEEDLOOM_<FIELD>``."""

    app_name: str = "deedloom"
    environment: str = "development"
    extraction_model: str = "rules"
    extraction_version: str = "v1"
    document_cache_version: str = "v1"
    extractor_url: str = "http://localhost:11434/v1"
    warehouse: str = "spark-warehouse"

    @classmethod
    def read(cls, spark: SparkSession | None = None) -> "Settings":
        """Session configuration wins over the environment, which wins over the defaults."""
        given = {}
        for name in cls.__dataclass_fields__:
            value = os.environ.get(f"DEEDLOOM_{name.upper()}")
            if spark is not None:
                value = spark.conf.get(f"spark.deedloom.{name}", value)
            if value is not None:
                given[name] = value
        return cls(**given)


@lru_cache(maxsize=1)
def settings() -> Settings:
    """The process-wide settings, read once."""
    return Settings.read()


def session(app_name: str = "deedloom", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the options all plans here assume (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data: the one that the cluster names in ``spark.checkpoint.dir`` or that was set
    before. Only a local session without either, as in tests, gets a folder below its warehouse; elsewhere it is an error.
    """
    context = spark.sparkContext
    there = context._jsc.sc().getCheckpointDir()
    if there.isEmpty():
        folder = spark.conf.get(CHECKPOINT_CONF, None)
        if not folder and not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} has to name a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse"), "_checkpoints"))
        there = context._jsc.sc().getCheckpointDir()
    return there.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors cost nothing.

    The files go when nothing refers to them any more, if the cluster sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``; sessions made here do.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark

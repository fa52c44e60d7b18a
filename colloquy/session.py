"""Session helpers: recommended settings, durable cut points and input spreading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any scale; sizes of partitions are left to AQE.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Fixed value: Spark's setting by which an action removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "colloquy", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the input folder (one file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors share: the one that ``spark.checkpoint.dir`` names.

    Only where that is unset (tests on one machine) a temporary folder is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="colloquy-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Actions on plans made inside remove their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Its shuffle files are removed at once, as nothing reads them any more; else
    they stay on disk until the driver happens to collect its garbage.
    """
    shared_folder(df.sparkSession)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, which takes the setting


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Repartition ``df`` only if it has fewer partitions than the cluster has cores.

    Used before Python stages: a table of one small file would otherwise run in
    one task. Large inputs already have many splits and are left alone. Only for
    scans and durable tables: asking a plan with a shuffle for its partitions
    would run the shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * factor)
    return df

"""Session settings, table loading and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quirestack")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; ``name`` is the Parquet file or folder without its suffix."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; set one of our own only where none is set."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix=f"quirestack-{os.getpid()}-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """A sample of about ``most`` rows by the hash of ``keys``, whatever the split into tasks; all rows where they are no more.

    The threshold comes from a count, so no task gathers more than its share (an ordered limit would bring ``most`` rows
    of every task to one).
    """
    rows = df.count()
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int((1 << 30) * most / rows))


def free_names(wanted: list[str], taken: list[str]) -> dict[str, str]:
    """New names for those of ``wanted`` that an operator's own output columns already use."""
    low = {t.lower() for t in taken}
    out = {}
    for name in wanted:
        new = name
        while new.lower() in low:
            new = f"in_{new}"
        low.add(new.lower())
        out[name] = new
    return out

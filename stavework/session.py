"""Session defaults and the one place lineage is cut."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
RELEASE_WAIT_S = 2


def build_session(app: str = "stavework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; on a cluster pass none of `master`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: the cluster's `spark.checkpoint.dir`.

    Only a session in one process, as in tests, gets a temporary folder where none is named; on a
    cluster that would be another disk on every machine, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "folder" not in _OWN:
        _OWN["folder"] = tempfile.mkdtemp(prefix="stavework-")
    return _OWN["folder"]


def new_folder(spark: SparkSession) -> str:
    """The name of a folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/stavework-{uuid.uuid4().hex}"


def share(df: DataFrame) -> DataFrame:
    """A table several branches of one job read, written once to the shared folder and read back.

    It ends the lineage, so plans stay flat and a lost executor costs no recomputation; readers
    prune its columns and see its real size. The written tables belong to the job: they are left
    for the folder's own clean-up, because lazy results may still read them.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share_rows(df: DataFrame) -> DataFrame:
    """`share` for a table of bars, units or groups, as long as the input: joins with it sort both sides.

    Spark judges by the file's size whether a table is small enough to go to every task by way of the driver, and such
    rows, mostly repeated small numbers, lie in a file a hundred times smaller than they are in memory. A table small
    by construction still goes out with `F.broadcast`, which outranks this.
    """
    return share(df).hint("merge")


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished tables now.

    Its cleaner removes them once the driver has collected the plans that made them, which a driver with
    much free memory may not do for half an hour; a job of several large shuffles would hold all their files till then.
    Python tells the driver of dropped plans from a thread of its own, about once a second; without the wait the newest
    plan would outlive the call, and its files the next step.
    """
    gc.collect()
    time.sleep(RELEASE_WAIT_S)
    spark.sparkContext._jvm.System.gc()

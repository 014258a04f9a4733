"""Session settings and durable cuts of lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that every query relies on; sizes stay those of the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", app: str = "vectide", **conf: str) -> SparkSession:
    """A session for local use and tests. A cluster brings its own; only REQUIRED matters there."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (REQUIRED | {"spark.ui.enabled": "false"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the checkpoint folder of the session as it is; a private temporary one is made only
    where none is set and the master is local."""
    root = spark.sparkContext._jsc.sc().getCheckpointDir()
    if root.isDefined():
        return root.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vectide-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the shared folder; the result survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

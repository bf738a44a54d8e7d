"""The folder for checkpoints: the session's, or one of its own in local tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure(spark: SparkSession) -> None:
    """Set the checkpoint folder where the session has none: a temporary one for a local
    session, the warehouse for any other."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = sc.master == "local" or sc.master.startswith("local[")
        folder = tempfile.mkdtemp(prefix="zonalis-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    sc.setCheckpointDir(folder)

"""Where intermediate tables of a job go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables on the storage the cluster names.

    That is `spark.checkpoint.dir`. Only a local session may do without it and then gets a
    temporary folder; on a cluster a machine-local one would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="rosterloom-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

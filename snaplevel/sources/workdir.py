"""Where intermediate tables and stream checkpoints are written."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="snaplevel-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, under the shared folder that the cluster names.

    Without that setting the session must be a local one, as in tests; a machine's own temporary
    folder would be lost with the machine.
    """
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"

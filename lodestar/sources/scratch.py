"""A folder that all executors share, for tables that cut a lineage or serve several queries."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir; under a temporary one only where that is unset and the session is local."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"file://{tempfile.gettempdir()}/lodestar-scratch"
    return f"{place.rstrip('/')}/lodestar-{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_files_go(spark: SparkSession):
    """Shuffle files of what runs inside are deleted when it ends, not when the driver's collector gets to them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)

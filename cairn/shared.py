"""The folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session without one gets a temporary
    folder; on a cluster a machine's own folder would lose tables with it, so there it must be set."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    here = getattr(spark, "_cairn_shared", None)
    if here is None:
        here = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
        spark._cairn_shared = here
    return here


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return

"""Where intermediate results live so that they outlast a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, shared by all its executors.

    ``spark.checkpoint.dir`` names it.  Only a local session, whose driver is
    its executor, gets a temporary folder where that setting is missing; a
    cluster session is refused, because a folder of one machine cannot serve
    the others.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="tabkit-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below :func:`shared_dir` that no earlier call returned."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    Meant for small results that several later steps read: label counts, group
    means, mode rows.  Costs one job; the blocks sit in the shared folder.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    For a large table that several later steps read: text is parsed once, and
    each step then reads only its own columns and row groups.
    """
    path = shared_path(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go as soon as it has run, not when the driver collects its garbage.

    For a job of many stored steps, whose files would otherwise add up.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that :func:`store` wrote inside.

    Frames that read them are of no use afterwards.  Checkpoints go by
    themselves with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    before = len(_written)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _written[before:]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        del _written[before:]

"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made = threading.local()


#: Bytes of a generated method that HotSpot still compiles.
COMPILED_METHOD = 8_000


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings that results depend on: day and hour boundaries are UTC. And one for speed:
    stages of many expressions, such as the contract check, would be generated as one method
    that is too long for the JVM to compile; beyond this limit Spark generates short ones."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED_METHOD))
    return allow_repeated_keys(spark)


def allow_repeated_keys(spark: SparkSession) -> SparkSession:
    """Properties with a repeated JSON key are parsed; otherwise they would escape the
    masking rules."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, so that functions of it run
    on them wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    # the driver's own folder: workers fetch the file from the driver, as they do any added file
    own = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    archive = os.path.join(own, f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as package:
        for folder, _, files in sorted(os.walk(root)):
            for file in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, file)
                package.write(path, os.path.join(name, os.path.relpath(path, root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="eventloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/eventloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and go on from there.

    Cuts the lineage, so a lost executor does not repeat the steps before, and lets
    several later steps each read just the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    if getattr(_made, "paths", None) is not None:
        _made.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropping_scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside go when the block ends: for micro-batches, of
    which a long-running stream has any number. Results must be written by then."""
    outer = getattr(_made, "paths", None)
    _made.paths = []
    try:
        yield
    finally:
        paths, _made.paths = _made.paths, outer
        for path in paths:
            _delete(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has put into the shared folder. Call it when the
    results have been written to their own place."""
    _delete(spark, _scratch_root(spark))

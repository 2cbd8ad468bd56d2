"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app_name: str = "foliospark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for: ANSI, UTC, adaptive execution."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # else every Column call also records where it was made
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that their Python workers can import it from anywhere."""
    context = spark.sparkContext
    if getattr(context, "_foliospark_sent", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="foliospark-")) / "foliospark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._foliospark_sent = True


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of the machine: on a cluster every executor
    has to see what another one wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Within it Python workers get at most so many rows at a time: a batch of whole texts is held several times, in the JVM, on the way
    and in the worker, so ten thousand long ones are hundreds of MB in every task. Plans that are run within it keep to that."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    given = int(before or 0)
    spark.conf.set(name, str(min(given, rows) if given > 0 else rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it a job's shuffle files go once its result is written, not when the driver's garbage collector finds them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def discard(*tables) -> None:
    """Remove tables that ``materialize`` wrote, when nothing will read them again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, purpose: str):
    """Write ``df`` once to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written

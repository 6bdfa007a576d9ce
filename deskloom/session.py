"""Session helpers: local sessions for tests and bench, and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "deskloom", **conf: str) -> SparkSession:
    """A session for tests and bench; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        # Above this size the JVM interprets a generated method instead of compiling it.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(os.path.abspath("spark-checkpoints"))
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it.

    That suffices for local sessions and shared installs; elsewhere pass it with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or the context's own.

    There is no other choice: a folder of one machine would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return configured


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


#: Whether a job's shuffle files go as soon as it has ended.
_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession, **conf: str) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver happens to collect its garbage.

    Other settings that hold inside come with ``__`` for the dots of their names.
    """
    inside = {_FREES: "true", **{k.replace("__", "."): v for k, v in conf.items()}}
    before = {k: spark.conf.get(k, None) for k in inside}
    for k, v in inside.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Paths that the innermost block of ``scratch`` has pinned.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a stored folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession, keep: int = 0) -> Iterator[None]:
    """Tables pinned inside go at the end of the block, but for the last ``keep``, which count as pinned behind it.

    Nothing that is read later may hang on the others.
    """
    made: list[str] = []
    outer = _MADE.set(made)
    kept = []
    try:
        yield
        kept = made[len(made) - keep :]
    finally:
        _MADE.reset(outer)
        around = _MADE.get()
        if around is not None:
            around += kept
        for path in made:
            if path not in kept:
                drop(spark, path)


def pin(df: DataFrame, name: str = "pinned", split_bytes: int | None = None, compression: str | None = None) -> DataFrame:
    """Fix the rows of ``df`` as a table in the shared folder, so that all later plans see the same.

    A table, unlike a checkpoint, lets later plans read single columns and know sizes. Row groups of
    ``split_bytes`` let many tasks read what few have written.
    """
    path = new_shared_path(df.sparkSession, name)
    writer = df.write if split_bytes is None else df.write.option("parquet.block.size", split_bytes)
    if compression is not None:
        writer = writer.option("compression", compression)
    if (made := _MADE.get()) is not None:
        made.append(path)
    with freeing(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session settings and the places where intermediate tables may be written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    executors share the driver's disk, may fall back to a temporary folder.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="cohortlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def pin(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder once, with the writer's ``options``, and go on from the written table.

    Used where a table must not change between two uses (sketch-based split points), where
    several jobs follow, and where iterations would let the plan grow without end. A lost
    executor then costs a re-read, never a recomputation from the start.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._pinned = True
    return table


def pinned(df: DataFrame) -> bool:
    """Whether ``df`` is a table as ``pin`` gave it, so that a further pass only reads it."""
    return bool(vars(df).get("_pinned"))


def stored(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` itself where ``pin`` gave it, else its ``columns`` pinned: several passes then share one run of its plan."""
    return df if pinned(df) else pin(df.select(*dict.fromkeys(columns)))


def discard(df: DataFrame) -> None:
    """Delete a table that ``pin`` wrote and nothing reads any more; anything else is left alone.

    For loops that write a new version of a table time and again.
    """
    spark = df.sparkSession
    root = shared_root(spark).rstrip("/")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[0].endswith(root.split(":", 1)[-1].lstrip("/")) and folder.rsplit("/", 1)[1].startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

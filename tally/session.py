"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the jobs are designed around. All are runtime settings; skew-join
# splitting is what keeps a join safe when one key holds a large share of rows.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Removes the shuffle files of an SQL job when the job ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# What a task of a narrow stage is dealt: sorts and hash tables of compressed rows take many times their size on disk.
NARROW_BYTES = "16m"
NARROW_PARTITIONS = 1024


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tally")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.lru_cache(maxsize=1)
def _private_dir() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _private_dir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    On one machine, and only where the setting is absent, a private folder is used.
    """
    return os.path.join(_shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The settings inside the block; what was there before comes back after it."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _narrow(spark: SparkSession) -> dict[str, str]:
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), NARROW_PARTITIONS)
    return {
        "spark.sql.files.maxPartitionBytes": NARROW_BYTES,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": NARROW_BYTES,
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
    }


def stage(df: DataFrame, label: str = "stage", narrow: bool = False) -> DataFrame:
    """Write ``df`` once and return the written table.

    Used where several later steps read one expensive result: the work is done a
    single time, the lineage is cut, the result outlives lost executors, and
    Catalyst sees the table's true size when it picks join strategies. The shuffle
    files of the job go with its end, since what follows reads the table.

    A ``narrow`` stage deals its tasks at most about ``NARROW_BYTES`` each, so that the
    memory of a task does not grow with the input; for steps that sort or group whole tables.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with settings(spark, {SHUFFLE_CLEANUP: "true"} | (_narrow(spark) if narrow else {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def sent(spark: SparkSession, *values: object) -> Iterator[Broadcast]:
    """The values as a broadcast whose copies on every machine go with the block.

    What a function carries itself stays on their disks until the driver happens to collect its garbage.
    """
    held = spark.sparkContext.broadcast(values)
    try:
        yield held
    finally:
        held.destroy()


def unstage(df: DataFrame) -> None:
    """Delete the files of a table of :func:`stage` that nothing reads any more."""
    spark = df.sparkSession
    for path in {os.path.dirname(name) for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def literal_rows(spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A few known rows as a frame that stays in the JVM and whose size Catalyst knows."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))

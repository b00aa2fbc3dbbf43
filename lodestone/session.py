"""A session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join of at most this many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of a few numbers that a task of a join sorts, where tables are dealt by ``tasks_of``.
TASK_ROWS = 500_000


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks: UTC, adaptive plans."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def tasks_of(*tables: DataFrame) -> int:
    """Tasks to deal ``tables`` to, so that none has much over ``TASK_ROWS`` of the largest; Spark alone goes by compressed bytes, of which sorted keys have few."""
    return max(1, -(-max(t.count() for t in tables) // TASK_ROWS))


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule or configuration table from values in the code; its size is that of the code."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Working tables in the shared folder of the cluster, and size-checked broadcasts."""

from __future__ import annotations

import functools
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of at most this many rows are broadcast; a side with more is shuffled.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a folder of this machine; on a cluster,
    whose machines don't see each other's folders, that is an error.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = _local_folder()
    return folder.rstrip("/")


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lodestone-")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


class Scratch:
    """Tables of one run of an operator, written once and read many times.

    Writing cuts the lineage: a lost executor costs the tasks of one step, and
    what was read from a table stays the same when it is read again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("error").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` (narrow) rows, else unchanged: a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string): other columns of any name can't clash with those of an operator."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def frame_of(rows: list[tuple], columns: list[str], whole: list[str]) -> pd.DataFrame:
    """A frame whose ``whole`` columns are exact integers or nulls; pandas alone would make them floats."""
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    return frame.assign(**{c: pd.array(frame[c].tolist(), "Int64") for c in whole})


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Arrow batches of at most ``rows`` rows and about ``size``, so that Python workers hold few long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)

"""Sources: file trees, records, discovery and limits."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import path_allowed

#: Media types by file ending.
MEDIA = {".md": "text/markdown", ".ts": "text/declaration", ".txt": "text/plain"}


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of all files below ``root``; paths are relative."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    cut = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace("file://", "") + "/", "")
    return files.select(cut.alias("path"), F.col("length").alias("size"), "content")


def media_type(path: Column) -> Column:
    found = F.lit(None).cast("string")
    for ending, media in MEDIA.items():
        found = F.when(F.endswith(path, F.lit(ending)), media).otherwise(found)
    return found


def texts(files: DataFrame, include: list[str], exclude: list[str], most_bytes: int) -> DataFrame:
    """(path, media, text, issue): allowed files; too large ones and invalid UTF-8 are issues without a text."""
    decoded = F.expr("try_validate_utf8(cast(content as string))")
    issue = F.when(F.col("size") > most_bytes, "too_large").when(decoded.isNull() & F.col("content").isNotNull(), "not_utf8")
    kept = files.where(path_allowed(F.col("path"), include, exclude))
    return kept.select("path", media_type(F.col("path")).alias("media"), F.when(issue.isNull(), decoded).alias("text"), issue.alias("issue"))


def discovery(seeds: DataFrame, inventory: DataFrame, include: list[str], exclude: list[str]) -> tuple[DataFrame, DataFrame]:
    """(found, problems): seed paths (path) that are in the inventory and allowed; the others with a reason."""
    allowed = seeds.withColumn("ok", path_allowed(F.col("path"), include, exclude))
    there = allowed.join(inventory.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").fillna(False, ["there"])
    problems = there.where("not ok or not there").select("path", F.when(~F.col("ok"), "not_allowed").otherwise("missing").alias("reason"))
    return there.where("ok and there").select("path"), problems


def strict_records(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of JSON text with ``record``, or ``problem``: not_json, not_object, duplicate_key, unknown_key, missing_key, wrong_type.

    Keys count at every depth.  A whole number must be one and fit its type, a number
    must be finite, text must be text; null is allowed.  Repeated keys are lost in any
    JSON parser of the JVM, so records are looked at in Python.
    """
    wanted = T.StructType.fromDDL(schema)

    def problems(values: pd.Series) -> pd.Series:
        return pd.Series([_problem(v, wanted) for v in values], dtype=object)

    checked = lines.withColumn("problem", F.pandas_udf(problems, "string")(column))
    return checked.withColumn("record", F.when(F.col("problem").isNull(), F.from_json(column, wanted, {"mode": "FAILFAST"})))


class _Object(list):
    """The (key, value) pairs of a JSON object; a list is a JSON array."""


_WHOLE = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def _problem(value: str | None, wanted: T.StructType) -> str | None:
    try:
        found = json.loads(value or "", object_pairs_hook=_Object, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return "not_json"
    return _mismatch(found, wanted) if isinstance(found, _Object) else "not_object"


def _mismatch(value: object, wanted: T.DataType) -> str | None:
    """The first problem of a value for a type, from the outside in."""
    if value is None:
        return None
    if isinstance(wanted, T.StructType):
        if not isinstance(value, _Object):
            return "wrong_type"
        keys, types = [k for k, _ in value], {f.name: f.dataType for f in wanted.fields}
        if len(keys) != len(set(keys)):
            return "duplicate_key"
        if set(keys) != set(types):
            return "unknown_key" if set(keys) - set(types) else "missing_key"
        return next(filter(None, (_mismatch(v, types[k]) for k, v in value)), None)
    if isinstance(wanted, T.ArrayType):
        return next(filter(None, (_mismatch(v, wanted.elementType) for v in value)), None) if type(value) is list else "wrong_type"
    if isinstance(wanted, T.StringType):
        good = isinstance(value, str)
    elif isinstance(wanted, T.BooleanType):
        good = isinstance(value, bool)
    elif type(wanted) in _WHOLE:
        bound = 1 << (_WHOLE[type(wanted)] - 1)
        good = type(value) is int and -bound <= value < bound
    elif isinstance(wanted, (T.FloatType, T.DoubleType)):
        good = type(value) in (int, float) and abs(value) < float("inf")
    else:
        raise ValueError(f"no rule for {wanted.simpleString()}")
    return None if good else "wrong_type"


def hunks(lines: DataFrame, column: str = "hunk") -> DataFrame:
    """``start`` and ``count`` of ``start:count`` texts; null where a text isn't of that form."""
    ok = F.col(column).rlike(r"^[0-9]+:[0-9]+$")
    part = lambda k: F.when(ok, F.split(F.col(column), ":")[k].cast("int"))
    return lines.withColumn("start", part(0)).withColumn("count", part(1))


def select_samples(samples: DataFrame, category: str | None = None, sample_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Samples of a category or an id, in the order of their ids; at most ``limit`` where one is asked for."""
    found = samples
    if category is not None:
        found = found.where(F.col("category") == category)
    if sample_id is not None:
        found = found.where(F.col("sample_id") == sample_id)
    found = found.orderBy("sample_id")
    return found if limit is None else found.limit(limit)

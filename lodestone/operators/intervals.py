"""Intervals, islands and coverage of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, width: int = 64) -> DataFrame:
    """Points with the intervals [start, end] of the same keys that contain them; intervals that end before they start hold none.

    A range join as an equi-join: an interval is listed under the bins that it
    touches at its own level, where bins (``width`` and its doublings) are no
    shorter than it, so under two at most however long it is.  Points look into
    their bin at each level that there is, of which there are at most 64.
    """
    real = intervals.where(F.col("end") >= F.col("start"))
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("end") - F.col("start") + 1) / width))).cast("int")
    leveled = real.withColumn("__level", level)
    bin_of = lambda c: F.floor(c / (width * F.pow(F.lit(2.0), F.col("__level"))))
    bins = leveled.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end")))))
    at = points.crossJoin(F.broadcast(leveled.select("__level").distinct())).withColumn("__bin", bin_of(F.col(point)))
    joined = at.join(bins, [*keys, "__level", "__bin"])
    return joined.where(F.col(point).between(F.col("start"), F.col("end"))).drop("__bin", "__level")


def innermost(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of the intervals that contain a point (``keys``) those that hold no other of them strictly.

    Strictly nested means inside and smaller.  Among the intervals of one point, one
    holds another only if it starts earlier and ends later or at the same end, so
    the latest start and the smallest end among the others decide: an interval
    stays unless a strictly smaller one lies within it.
    """
    other = hits.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e")).distinct()
    nested = (F.col("__s") >= F.col("start")) & (F.col("__e") <= F.col("end")) & ((F.col("__s") > F.col("start")) | (F.col("__e") < F.col("end")))
    a, b = hits.alias("a"), other.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = nested
    for s in same:
        cond = cond & s
    return a.join(b, cond, "left_anti").select("a.*")


def nearest_enclosing(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, parent): the smallest interval of ``outer`` that holds each interval of ``inner`` strictly; ties to the smaller id."""
    o = outer.select(*keys, F.col("id").alias("parent"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    inside = (F.col("__s") <= F.col("start")) & (F.col("__e") >= F.col("end")) & ((F.col("__s") < F.col("start")) | (F.col("__e") > F.col("end")))
    pairs = inner.join(o, keys).where(inside)
    return pairs.groupBy(*keys, "id").agg(F.min_by("parent", F.struct((F.col("__e") - F.col("__s")).alias("size"), F.col("parent"))).alias("parent"))


def islands(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, first, last, n) of runs of consecutive values."""
    numbered = rows.select(*keys, line).distinct().withColumn("__g", F.col(line) - F.row_number().over(Window.partitionBy(*keys).orderBy(line)))
    return numbered.groupBy(*keys, "__g").agg(F.min(line).alias("first"), F.max(line).alias("last"), F.count("*").alias("n")).drop("__g")


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, atoms): units (id, atom) of two sides that share an atom, with the sorted atoms."""
    l, r = left.select(F.col("id").alias("left_id"), "atom").distinct(), right.select(F.col("id").alias("right_id"), "atom").distinct()  # noqa: E741
    return l.join(r, "atom").groupBy("left_id", "right_id").agg(F.array_sort(F.collect_list("atom")).alias("atoms"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once: an empty result is the check."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage_gaps(lines: DataFrame, keys: list[str], line: str, length: DataFrame) -> DataFrame:
    """(keys, line, problem): lines covered twice, or of 1..n (``length``: keys, n) not covered, or beyond n."""
    counts = lines.groupBy(*keys, line).agg(F.count("*").alias("c"))
    twice = counts.where("c > 1").select(*keys, F.col(line).cast("long").alias("line"), F.lit("repeated").alias("problem"))
    wanted = length.select(*keys, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("line"))
    have = counts.select(*keys, F.col(line).cast("int").alias("line"))
    missing = wanted.join(have, [*keys, "line"], "left_anti").select(*keys, F.col("line").cast("long").alias("line"), F.lit("missing").alias("problem"))
    beyond = have.join(wanted, [*keys, "line"], "left_anti").select(*keys, F.col("line").cast("long").alias("line"), F.lit("beyond").alias("problem"))
    return twice.unionByName(missing).unionByName(beyond)


def hunk_units(hunks: DataFrame, units: DataFrame, keys: list[str], around: int) -> DataFrame:
    """(keys, hunk_id, unit_id, start, end): enclosing units of each hunk, or a window of ``around`` lines where nothing encloses it.

    ``hunks`` has h_start, h_end and n_lines of the file.
    """
    pairs = hunks.join(units, keys).where((F.col("start") <= F.col("h_end")) & (F.col("end") >= F.col("h_start")))
    found = pairs.select(*keys, "hunk_id", "unit_id", "start", "end")
    alone = hunks.join(found, [*keys, "hunk_id"], "left_anti")
    window = alone.select(
        *keys, "hunk_id", F.concat(F.lit("window:"), F.col("hunk_id").cast("string")).alias("unit_id"),
        F.greatest(F.lit(1), F.col("h_start") - around).alias("start"), F.least(F.col("n_lines"), F.col("h_end") + around).alias("end"),
    )
    return found.withColumn("unit_id", F.col("unit_id").cast("string")).unionByName(window)


def merge_units(units: DataFrame) -> DataFrame:
    """One row a unit_id with the sorted union of its lines and diagnostics; null elements go.

    Values are made distinct by a shuffle before they are gathered, so a unit of
    very many rows is only as large as its distinct values.
    """

    def union(c: str) -> DataFrame:
        one = units.select("unit_id", F.explode_outer(c).alias("v")).distinct()
        return one.groupBy("unit_id").agg(F.array_sort(F.collect_list("v")).alias(c))

    a, b = union("lines"), union("diagnostics").withColumnRenamed("unit_id", "__u")
    return a.join(b, a["unit_id"].eqNullSafe(b["__u"])).drop("__u")


def ordinals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``ordinal`` from 1 within keys, and ``n_same`` of rows with the same keys."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("ordinal", F.row_number().over(w.orderBy(*order))).withColumn("n_same", F.count("*").over(w))


def neighbours(rows: DataFrame, keys: list[str], order: list[str], value: str, same: str) -> DataFrame:
    """``previous`` and ``next`` value within keys where column ``same`` agrees with the row's own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    near = lambda f: F.when(f(F.col(same)).over(w).eqNullSafe(F.col(same)), f(F.col(value)).over(w))
    return rows.withColumn("previous", near(F.lag)).withColumn("next", near(F.lead))

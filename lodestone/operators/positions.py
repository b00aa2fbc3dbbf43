"""Places in texts, in code points, UTF-16 units, UTF-8 bytes and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places of one text that are looked up together; more are dealt to several rows of that text.
POINTS = 8192
UNITS = ("point", "utf16", "utf8")


class PositionMap:
    """Sorted tables of one text: units before each code point, and the code points that begin lines."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        wide = [np.ones(len(codes), np.int64), 1 + (codes >= 0x10000), 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)]
        self.before = {u: np.concatenate(([0], np.cumsum(w, dtype=np.int64))) for u, w in zip(UNITS, wide, strict=True)}
        self.lines = np.concatenate(([0], np.flatnonzero(codes == 10) + 1))

    def look_up(self, unit: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code points before each offset, whether it is a place of the text): not inside a character, nor outside the text."""
        table = self.before[unit]
        at = np.searchsorted(table, offsets)
        known = (at < len(table)) & (offsets >= 0)
        at = np.where(known, at, 0)
        return at, known & (table[at] == offsets)

    def line_column(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both from 1; a line feed belongs to the line that it ends."""
        line = np.searchsorted(self.lines, at, side="right")
        return line, at - self.lines[line - 1] + 1


def positions(texts: DataFrame, points: DataFrame) -> DataFrame:
    """(id, unit, at, point, utf16, utf8, line, column) of places ``points`` (id, unit, at) in ``texts`` (id, text).

    ``unit`` says what ``at`` counts: point, utf16 or utf8.  A place inside a character or
    outside its text, an unknown unit and a null place have nulls; a null text is
    empty; places of ids without a text are left out, as are null ids.
    """
    number = F.row_number().over(Window.partitionBy("id").orderBy("unit", "at")) - 1
    asked = points.select("id", "unit", F.col("at").cast("long").alias("at")).where("id is not null").distinct()
    dealt = asked.withColumn("part", F.floor(number / POINTS)).groupBy("id", "part").agg(F.collect_list(F.struct("unit", "at")).alias("points"))
    joined = dealt.join(texts.select("id", F.coalesce("text", F.lit("")).alias("text")), "id").select("id", "text", "points")
    id_type = joined.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = PositionMap(batch.column("text")[k].as_py())
                asked = batch.column("points")[k].as_py()
                at = np.zeros(len(asked), np.int64)
                known = np.zeros(len(asked), bool)
                for unit in UNITS:
                    those = np.array([i for i, p in enumerate(asked) if p["unit"] == unit and p["at"] is not None], np.int64)
                    at[those], known[those] = found.look_up(unit, np.array([asked[i]["at"] for i in those], np.int64))
                line, column = found.line_column(at)
                values = [found.before[u][at] for u in UNITS] + [line, column]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array([k] * len(asked))), pa.array([p["unit"] for p in asked], pa.string()), pa.array([p["at"] for p in asked], pa.int64()), *(pa.array(v.astype(np.int64), mask=~known) for v in values)],
                    names=["id", "unit", "at", "point", "utf16", "utf8", "line", "column"],
                )

    return joined.mapInArrow(task, f"id {id_type}, unit string, at long, point long, utf16 long, utf8 long, line long, column long")

"""WARC archives of pages, and a global capture index merged from sorted runs.

Writing: equal payloads of at least ``MIN_REVISIT`` bytes are stored once, as the
response of their largest page_id; the others are revisit records that refer to
it.  A record is one row of a text file whose line separator is the pair of line
ends that closes a WARC record, so Spark's own writer makes the archives on any
file system.  Reading: each archive is cut by its Content-Length fields (payloads
may hold anything, the text of another record too), and yields a capture run
sorted by (URL key, timestamp, page_id).  The runs are dealt out by range of that
key and merged in each range by a loser tree, which gives a globally ordered
capture history.

Null html is an empty payload; a null url has an empty URL key; a null page_id is
smaller than any number.  Rows that repeat the page_id of a response are
responses too.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, checked_broadcast, frame_of, small_batches

MIN_REVISIT = 1000
#: Archives of about this many bytes.
FILE_BYTES = 8 * 1024 * 1024
#: Index entries that one range of the merge holds at most, about.
RANGE_ROWS = 8_192
#: Captures have no time of their own: a second for each page_id from 2024 on, in a cycle that ends before the year 9999.
EPOCH, CYCLE = 1_704_067_200, 1 << 37
_ID = "urn:page:"
_NONE = "null"
_COLUMNS = ["url_key", "captured", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_offset", "record_bytes"]
_RUN = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_offset long, record_bytes long"


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query, all lower case."""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    return (labels + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")).lower()


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the root the winner.

    Only the first key of each run is held; equal keys go to the earlier run.
    """

    def __init__(self, runs: Sequence[Iterable[tuple]]):
        self.rest = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.rest]
        n = len(self.rest)
        self.tree = [-1] * max(n, 1)
        for run in range(n):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        """An exhausted run loses to every other."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return x < y or (x == y and a < b)

    def _play(self, run: int) -> None:
        node = (run + len(self.rest)) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # the opponent has not come yet
                self.tree[node] = run
                return
            if self._beats(other, run):
                self.tree[node], run = run, other
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator[tuple]:
        n = len(self.rest)
        while n:
            run = self.tree[0]
            head = self.heads[run]
            if head is None:
                return
            yield head
            self.heads[run] = next(self.rest[run], None)
            node = (run + n) // 2
            while node > 0:
                if self._beats(self.tree[node], run):
                    self.tree[node], run = run, self.tree[node]
                node //= 2
            self.tree[0] = run


def _records(pages: DataFrame, min_revisit: int) -> DataFrame:
    """(value, size) of a record for each row."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"))
    p = p.withColumn("sha1", F.sha1(F.col("payload").cast("binary"))).withColumn("sha256", F.sha2(F.col("payload").cast("binary"), 256))
    same = p.where(F.col("bytes") >= min_revisit).groupBy("sha1", "sha256").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    shared = same.where("n > 1").drop("n")
    p = p.join(checked_broadcast(shared), ["sha1", "sha256"], "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    name = F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit(_NONE)), F.lit(">"))
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(CYCLE))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name,
        F.lit("\r\nWARC-Date: "), when, F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <"), F.lit(_ID), F.col("response_id").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
    )
    return p.select(F.concat(head, F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, out: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Writes (page_id, url, html) rows as WARC files of about ``file_bytes`` under ``out``."""
    mean = pages.select(F.avg(F.octet_length("html"))).first()[0] or 0
    records = max(1, int(file_bytes / (mean + 600)))
    _records(pages, min_revisit).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(out)


def parse_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, bytes) of each record, by the lengths that the headers give."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        body = end + 4
        after = body + int(head["Content-Length"])
        yield head, raw[body:after], at, after + 4 - at
        at = after + 4


def _page(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(_ID)
    return int(text) if text and text != _NONE else None


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def capture_run(raw: bytes) -> list[tuple]:
    """The captures of one archive, sorted by (URL key, timestamp, page_id)."""
    run = []
    for head, block, at, size in parse_archive(raw):
        if head["WARC-Type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
        else:
            n, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
        target = head.get("WARC-Target-URI", "")
        key = url_key(target) if target else ""
        run.append((key, head["WARC-Date"], _page(head["WARC-Record-ID"]), n, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To")), at, size))
    return sorted(run, key=_order)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(file, k, capture columns): each archive's captures in order; k counts within the file."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, raw in zip(batch["file"], batch["content"], strict=True):
                run = [(file, k, *row) for k, row in enumerate(capture_run(bytes(raw)))]
                yield frame_of(run, ["file", "k", *_COLUMNS], ["k", "page_id", "payload_bytes", "refers_to", "record_offset", "record_bytes"])

    small_batches(spark, 4, "8m")
    files = spark.read.format("binaryFile").load(path)
    files = files.select(F.substring_index("path", "/", -1).alias("file"), "content")
    return files.mapInPandas(rows, f"file string, k long, {_RUN}")


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order of (range_no, range_pos); range_no grows with the key.

    A range is one Arrow table of about ``range_rows`` entries, sorted by (file, k):
    the pieces of all runs that reach into it, which the loser tree merges as
    iterators over (key, place).  The last key of the range is page_id, so a URL
    with any number of captures is split too.
    """
    ranges = max(1, -(-runs.count() // range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        files = table["file"].to_pylist()
        ids = table["page_id"].to_pylist()
        keys = list(zip(table["url_key"].to_pylist(), table["captured"].to_pylist(), [i is not None for i in ids], [i or 0 for i in ids], files, range(len(ids)), strict=True))
        cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
        order = pa.array([key[-1] for key in LoserTree([itertools.islice(keys, a, b) for a, b in itertools.pairwise(cuts)])], pa.int64())
        merged = table.take(order).append_column("range_pos", pa.array(range(len(ids)), pa.int64()))
        yield from merged.select(names).to_batches(max_chunksize=5000)

    names = ["range_no", "range_pos", "file", *_COLUMNS]
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("file", "k")
    dealt = dealt.withColumn("range_no", F.spark_partition_id())
    return dealt.mapInArrow(merge, f"range_no int, range_pos long, file string, {_RUN}")


def capture_history(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Archives the pages, reads the archives back and merges their runs.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, and the
    capture's url_key, time, file, place in it and place in the global order).
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    narrowed = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    order = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "file", "record_offset", "record_bytes", "range_no", "range_pos"]
    if narrowed.isEmpty():
        return spark.createDataFrame([], f"range_no int, range_pos long, file string, {_RUN}").select(*order)
    write_archives(narrowed, scratch.path("archives"), min_revisit)
    runs = scratch.table(read_runs(spark, scratch.path("archives")), "runs")
    return merge_runs(runs).select(*order)

"""Adapters that turn files of a source into normalised documents.

Files are a table (source_id, path, content), from ``readers.file_tree`` or any other
place that Spark reads: pruned columns and filters on size or path reach the reader,
and a file is one row, so sources of any number of files are spread over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..markdown.blocks import blocks
from .readers import media_type

NORMALIZED = "document_id string, source_id string, path string, content_sha256 string, media string, title string, n_headings long, body string, language string, adapter_version string, diagnostics array<string>"


@dataclass(frozen=True)
class TextAdapter:
    """How the files of one source become documents; ``languages`` are path prefixes with their language, the first that fits counts."""

    source_id: str
    version: str
    language: str
    languages: tuple[tuple[str, str], ...] = ()

    def load(self, files: DataFrame) -> DataFrame:
        """(document_id, ..., body, language, adapter_version, diagnostics) of the source's files.

        The body is UTF-8 without a byte order mark and with line feeds alone.  A file that is
        not UTF-8, holds a NUL or has an unsafe path has a null body and says so in its
        diagnostics (not_utf8, nul, unsafe_path).  The title is the first heading of level
        1 in Markdown, else the file's name (missing_h1_title).
        """
        own = files.where(F.col("source_id") == self.source_id).select("path", "content")
        parts = F.split("path", "/")
        unsafe = F.startswith("path", F.lit("/")) | F.exists(parts, lambda p: p.isin(".", "..")) | F.contains("path", F.lit("\\"))
        decoded = F.regexp_replace(F.expr("try_validate_utf8(cast(content as string))"), "^﻿", "")
        nul = F.contains(decoded, F.lit("\0"))
        issue = F.when(unsafe, "unsafe_path").when(decoded.isNull() & F.col("content").isNotNull(), "not_utf8").when(nul, "nul")
        d = own.select("path", media_type(F.col("path")).alias("media"), F.sha2("content", 256).alias("content_sha256"), issue.alias("issue"), F.regexp_replace(decoded, "\r\n?", "\n").alias("text"))
        d = d.withColumn("body", F.when(F.col("issue").isNull(), F.coalesce("text", F.lit("")))).drop("text")
        heads = blocks(d.where("media = 'text/markdown' and body is not null"), "path", "body", front_matter=False).where("kind = 'heading' and trim(text) <> ''")
        heads = heads.groupBy(F.col("id").alias("path")).agg(F.min(F.when(F.col("level") == 1, F.struct("ordinal", F.trim("text").alias("title")))).alias("first"), F.count("*").alias("n_headings"))
        d = d.join(heads, "path", "left")
        language = F.lit(self.language)
        for prefix, name in reversed(self.languages):
            language = F.when(F.startswith("path", F.lit(prefix)), name).otherwise(language)
        untitled = (F.col("media") == "text/markdown") & F.col("body").isNotNull() & F.col("first").isNull()
        return d.select(
            F.concat(F.lit(f"{self.source_id}:"), F.col("path")).alias("document_id"), F.lit(self.source_id).alias("source_id"), "path", "content_sha256", "media",
            F.coalesce("first.title", F.substring_index("path", "/", -1)).alias("title"), F.coalesce("n_headings", F.lit(0)).cast("long").alias("n_headings"), "body", language.alias("language"), F.lit(self.version).alias("adapter_version"),
            F.filter(F.array("issue", F.when(untitled, "missing_h1_title")), lambda x: x.isNotNull()).alias("diagnostics"),
        )


def normalized(files: DataFrame, adapters: list[TextAdapter]) -> DataFrame:
    """Documents of all sources that have an adapter; two adapters of one source are an error."""
    names = [a.source_id for a in adapters]
    if len(names) != len(set(names)):
        raise ValueError("a source has two adapters")
    found = files.sparkSession.createDataFrame([], NORMALIZED)
    for adapter in adapters:
        found = found.unionByName(adapter.load(files))
    return found

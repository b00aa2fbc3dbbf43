"""File trees, adapters, caps, embeddings and write-once tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph, records, retrieval, tagging
from ..session import rows_of, table
from ..sources import adapters, readers
from ..sources.store import write_once


def file_trees(spark, sf_dir):
    """Customers' names as a file for each nation, listed and read back as a tree."""
    folder = f"{graph.work_folder(spark)}/tree"
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_name").alias("value"), "c_custkey")
    c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(folder)
    t = readers.file_tree(spark, folder).where("path like '%.txt'")
    return t.select(F.substring_index("path", "/", 1).alias("folder"), readers.media_type(F.col("path")).alias("media"), F.col("size").cast("long").alias("size"), F.sha2("content", 256).alias("content_sha256"))


def _files(spark, sf_dir):
    """Documents as files of two sources; some aren't UTF-8, some have a title, some a byte order mark or other line ends."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    ending = F.when(k % 3 == 0, ".md").when(k % 3 == 1, ".txt").otherwise(".d.ts")
    title = F.when(k % 2 == 0, F.concat(F.lit("# Title "), k.cast("string"), F.lit(" #\r\n\r\n## More\r\n\r\n"))).otherwise("")
    raw = F.concat(F.when(k % 5 == 0, F.unhex(F.lit("EFBBBF"))).when(k % 7 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit(""))), F.encode(F.concat(title, text), "UTF-8"))
    return d.select(F.when(k % 4 == 0, "notes").otherwise("guides").alias("source_id"), F.concat(F.coalesce("lang", F.lit("xx")), F.lit("/d"), k.cast("string"), ending).alias("path"), raw.alias("content"))


def normalized_documents(spark, sf_dir):
    """Files of two sources as documents: titles, languages, bodies and diagnostics by their adapters."""
    sources = [adapters.TextAdapter("guides", "guides-v1", "en", (("de/", "de-DE"), ("fr/", "fr-FR"))), adapters.TextAdapter("notes", "notes-v2", "und")]
    d = adapters.normalized(_files(spark, sf_dir), sources)
    return d.select("document_id", "media", "title", "n_headings", F.sha2("body", 256).alias("body_sha256"), "language", "adapter_version", F.array_join("diagnostics", ",").alias("diagnostics"))


def eligible_sources(spark, sf_dir):
    """Pages' paths that end in a digit 1, lie below a language folder, and in no excluded one."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("root/"), F.regexp_extract("url", r"^https?://[^/?#]+/?([^?#]*)", 1)).alias("path"))
    return p.select("page_id", "path", X.eligible_source(F.col("path"), "1", "en", ["80", "81"]).alias("eligible"))


def capped_units(spark, sf_dir):
    """Customers by nation, behind a cap on customers that is an error where it is passed."""
    c = records.require_at_most(table(spark, sf_dir, "customer"), 1_000_000_000, "customers")
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"))


class _Counts:
    """A provider of two-dimensional vectors from the size of a text."""

    model_id, version, dims = "counts", "1", 2

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[len(t) % 97 / 7, len(t.encode()) % 89 / 3] for t in texts]


def embedded_texts(spark, sf_dir):
    """Vectors of documents in single precision, joined to their texts by id, never by position."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    v = retrieval.embed(d, _Counts).select("doc_id", "vector")
    joined = d.select("doc_id", F.length("text").alias("n_chars")).join(v, "doc_id")
    return joined.select("doc_id", "n_chars", F.size("vector").alias("dims"), F.col("vector")[0].cast("double").alias("v0"), F.col("vector")[1].cast("double").alias("v1"))


def dimension_candidates(spark, sf_dir):
    """Dimensions of parts by their types and brands; deprecated ones don't count."""
    p = table(spark, sf_dir, "part")
    tags = p.select(F.col("p_partkey").alias("unit_id"), F.col("p_type").alias("tag_id")).unionByName(p.select(F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("tag_id")))
    return tagging.candidate_dimensions(tags, rows_of(spark, [(d, t, s) for d, s, ts in _DIMENSIONS for t in ts], "dimension_id string, tag_id string, status string"))


_DIMENSIONS = [("metal", "Active", ("STEEL", "COPPER", "Brand#11")), ("shine", "Draft", ("BRASS", "Brand#22")), ("old", "Deprecated", ("STEEL", "TIN"))]


def write_once_table(spark, sf_dir):
    """Suppliers written once; a second run of the same rows in another order changes nothing."""
    s, path = table(spark, sf_dir, "supplier"), f"{graph.work_folder(spark)}/once"
    write_once(s, path)
    return write_once(s.orderBy(F.desc("s_name")), path)


QUERIES = {f.__name__: f for f in (file_trees, normalized_documents, eligible_sources, capped_units, embedded_texts, dimension_candidates, write_once_table)}
ORACLES = {
    "file_trees": """SELECT 'c_nationkey=' || c_nationkey AS folder, 'text/plain' AS media, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS size, sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS content_sha256 FROM customer GROUP BY c_nationkey""",
    "normalized_documents": r"""
        WITH f AS (SELECT doc_id AS k, CASE WHEN doc_id % 4 = 0 THEN 'notes' ELSE 'guides' END AS s, coalesce(lang, 'xx') || '/d' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.d.ts' END AS path, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
        g AS (SELECT *, k % 5 <> 0 AND k % 7 = 0 AS broken, k % 3 = 0 AS md, k % 2 = 0 AS titled FROM f)
        SELECT s || ':' || path AS document_id, CASE k % 3 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/plain' ELSE 'text/declaration' END AS media,
               CASE WHEN md AND titled AND NOT broken THEN 'Title ' || k ELSE list_last(string_split(path, '/')) END AS title, CAST(CASE WHEN md AND titled AND NOT broken THEN 2 ELSE 0 END AS BIGINT) AS n_headings,
               CASE WHEN NOT broken THEN sha256(CASE WHEN titled THEN '# Title ' || k || ' #' || chr(10) || chr(10) || '## More' || chr(10) || chr(10) ELSE '' END || replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS body_sha256,
               CASE WHEN s = 'notes' THEN 'und' WHEN path LIKE 'de/%' THEN 'de-DE' WHEN path LIKE 'fr/%' THEN 'fr-FR' ELSE 'en' END AS language, CASE s WHEN 'notes' THEN 'notes-v2' ELSE 'guides-v1' END AS adapter_version,
               CASE WHEN broken THEN 'not_utf8' WHEN md AND NOT titled THEN 'missing_h1_title' ELSE '' END AS diagnostics FROM g""",
    "eligible_sources": r"""SELECT page_id, path, path LIKE '%1' AND path LIKE '%/en/%' AND path NOT LIKE '%/80/%' AND path NOT LIKE '%/81/%' AS eligible
        FROM (SELECT page_id, 'root/' || regexp_extract(url, '^https?://[^/?#]+/?([^?#]*)', 1) AS path FROM pages)""",
    "capped_units": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey",
    "embedded_texts": """SELECT doc_id, CAST(length(t) AS INT) AS n_chars, 2 AS dims, CAST(CAST(length(t) % 97 / 7.0::DOUBLE AS FLOAT) AS DOUBLE) AS v0, CAST(CAST(strlen(t) % 89 / 3.0::DOUBLE AS FLOAT) AS DOUBLE) AS v1 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "dimension_candidates": f"""SELECT DISTINCT p_partkey AS unit_id, d AS dimension_id FROM part JOIN (VALUES {", ".join(str((d, t)) for d, s, ts in _DIMENSIONS if s != "Deprecated" for t in ts)}) x(d, t) ON t = p_type OR t = p_brand""",
    "write_once_table": "SELECT * FROM supplier",
}

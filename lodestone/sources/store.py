"""Content-addressed snapshots of an index, with aliases, on any file system that Spark writes."""

from __future__ import annotations

import hashlib
import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class SnapshotConflict(ValueError):
    """A version is there already with another content, or fails its checks."""


def checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, digest of the sums of row digests): the same for any order or partitioning of the rows.

    A row's SHA-256 is added up as four whole numbers of 64 bits.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("digest", 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    got = df.select(digest.alias("digest")).agg(F.count("*").alias("n"), *parts).first()
    return got["n"], hashlib.sha256(":".join(str(got[f"p{k}"] or 0) for k in range(4)).encode()).hexdigest()


class SnapshotStore:
    """Immutable versions under ``root/versions`` and numbered pointers of aliases under ``root/aliases``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, version: str) -> str:
        return f"{self.root}/versions/index_version={version}"

    def version_of(self, entries: DataFrame) -> str:
        """The identity of the content: equal content has an equal version."""
        n, s = checksum(entries)
        return self.spark.sql(f"SELECT substr(sha2('{n}:{s}:{entries.schema.simpleString()}', 256), 1, 32) AS v").first()["v"]

    def exists(self, version: str) -> bool:
        try:
            return bool(self.spark.read.parquet(f"{self._path(version)}/manifest").limit(1).count())
        except AnalysisException:
            return False

    def publish(self, entries: DataFrame, version: str | None = None) -> str:
        """Writes a version, reads it back and seals it; publishing equal content again changes nothing."""
        version = version or self.version_of(entries)
        n, s = checksum(entries)
        if self.exists(version):
            if self._manifest(version) != (n, s):
                raise SnapshotConflict(f"version {version} has another content")
            return version
        entries.write.mode("overwrite").parquet(f"{self._path(version)}/entries")  # what a broken publish has left isn't sealed
        if checksum(self.spark.read.parquet(f"{self._path(version)}/entries")) != (n, s):
            raise SnapshotConflict(f"version {version} reads back differently")
        self.spark.createDataFrame([(n, s)], "n long, checksum string").coalesce(1).write.mode("error").parquet(f"{self._path(version)}/manifest")
        return version

    def _manifest(self, version: str) -> tuple[int, str]:
        row = self.spark.read.parquet(f"{self._path(version)}/manifest").first()
        return row["n"], row["checksum"]

    def load(self, version: str, verify: bool = True) -> DataFrame:
        """The entries of a sealed version; with ``verify`` its count and checksum must agree."""
        if not self.exists(version):
            raise SnapshotConflict(f"no version {version}")
        entries = self.spark.read.parquet(f"{self._path(version)}/entries")
        if verify and checksum(entries) != self._manifest(version):
            raise SnapshotConflict(f"version {version} is damaged")
        return entries

    def switch_alias(self, alias: str, version: str, origin: str = "approved", allowed: tuple[str, ...] = ("approved",), expected: str | None = None) -> int:
        """Points an alias to a sealed version; gives the number of its pointer.

        A pointer is a file whose number follows that of the newest one, and is made
        only if it isn't there: of two writers one gets the number, and the other one
        looks again.  With ``expected`` the alias must still point to that version.
        """
        if origin not in allowed:
            raise SnapshotConflict(f"origin {origin} may not switch aliases")
        if not self.exists(version):
            raise SnapshotConflict(f"no version {version}")
        while True:
            turn, now = self._newest(alias)
            if expected is not None and now != expected:
                raise SnapshotConflict(f"alias {alias} points to {now}, not to {expected}")
            if self._create(f"{self._folder(alias)}/{turn + 1:012d}.json", json.dumps({"alias": alias, "index_version": version, "origin": origin, "turn": turn + 1})):
                return turn + 1

    def _folder(self, alias: str) -> str:
        return f"{self.root}/aliases/{hashlib.sha256(alias.encode()).hexdigest()[:32]}"

    def _newest(self, alias: str) -> tuple[int, str | None]:
        """(the highest number taken, the version of the newest whole pointer): a writer may have died before it wrote."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self._folder(alias))
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        taken = [int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(".")]
        row = self.aliases().where(F.col("alias") == alias).orderBy(F.desc("turn")).first() if taken else None
        return max(taken, default=0), row["index_version"] if row else None

    def _create(self, path: str, content: str) -> bool:
        """Whether the file was made by this call; one that is there stays as it is.

        HDFS makes a file once; Hadoop's local file system looks first, so there Java makes it.
        Stores of objects that can't refuse to replace one aren't fit for aliases.
        """
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        local = target.toUri().getScheme() in (None, "file")
        try:
            if local:
                fs.mkdirs(target.getParent())
                jvm.java.nio.file.Files.createFile(jvm.java.io.File(target.toUri().getPath()).toPath(), self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            out = fs.create(target, local)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.toString()):
                return False
            raise
        out.write(bytearray((content + "\n").encode()))
        out.close()
        return True

    def aliases(self) -> DataFrame:
        """(alias, index_version, origin, turn) of all pointers."""
        schema = "alias string, index_version string, origin string, turn long"
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").json(f"{self.root}/aliases").where("turn is not null")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def resolve_alias(self, alias: str) -> str | None:
        return self._newest(alias)[1]

    def load_alias(self, alias: str) -> DataFrame:
        version = self.resolve_alias(alias)
        if version is None:
            raise SnapshotConflict(f"no alias {alias}")
        return self.load(version)


def seal_problems(atoms: DataFrame, bindings: DataFrame, binding_atoms: DataFrame, unclassified: DataFrame) -> DataFrame:
    """(id, problem): atoms that are classified and unclassified, or neither; bindings without atoms; unknown atoms."""
    used = binding_atoms.select("atom_id").distinct()
    both = used.join(unclassified, "atom_id", "left_semi").select(F.col("atom_id").alias("id"), F.lit("classified_twice").alias("problem"))
    neither = atoms.join(used, "atom_id", "left_anti").join(unclassified, "atom_id", "left_anti").select(F.col("atom_id").alias("id"), F.lit("not_classified").alias("problem"))
    empty = bindings.join(binding_atoms, "binding_id", "left_anti").select(F.col("binding_id").alias("id"), F.lit("empty_binding").alias("problem"))
    unknown = used.join(atoms, "atom_id", "left_anti").select(F.col("atom_id").alias("id"), F.lit("unknown_atom").alias("problem"))
    return both.unionByName(neither).unionByName(empty).unionByName(unknown)


#: Tables of a projection, in the order of ``seal_problems``.
PARTS = ("atoms", "bindings", "binding_atoms", "unclassified")


def publish_projection(store: SnapshotStore, parts: dict[str, DataFrame]) -> str:
    """Publishes the tables of a projection in two phases, and gives the version of the whole.

    First each table is a version of its own, which nothing points to (building).
    The tables are read back and must have no seal problem; only then is the list of
    their versions published (verified).  A second run of the same content changes
    nothing, and one that breaks off leaves no verified version.
    """
    versions = [(name, store.publish(parts[name])) for name in PARTS]
    problems = seal_problems(*(store.load(version) for _, version in versions))
    first = problems.orderBy("problem", "id").first()
    if first is not None:
        raise SnapshotConflict(f"{first['problem']}: {first['id']}")
    return store.publish(store.spark.createDataFrame(versions, "part string, index_version string").coalesce(1))


def load_projection(store: SnapshotStore, version: str) -> dict[str, DataFrame]:
    """The tables of a verified projection; its list has one row for each."""
    return {row["part"]: store.load(row["index_version"]) for row in store.load(version).collect()}


def write_once(df: DataFrame, path: str) -> DataFrame:
    """``df`` as the table at ``path``, which is written at most once: equal content is left as it is, another one is a conflict.

    The table is written and then sealed by a manifest, so what a broken run has left
    counts as nothing and is written anew.
    """
    store = SnapshotStore(df.sparkSession, path)
    return store.load(store.publish(df, version="only"))

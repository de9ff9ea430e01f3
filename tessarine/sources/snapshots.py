"""Tables that change by whole commits: immutable files, a manifest of what counts, and versions that only one writer can take."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.operators.lineage import tenant_bucket
from tessarine.operators.retrieval import counted_small


class Conflict(RuntimeError):
    """Another writer took the version that this commit was made from."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not be there yet; False where it is. Whole at once: the text is written aside and renamed."""
    fs, at = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    aside = jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at) or not fs.rename(aside, at):
        fs.delete(aside, False)
        return False
    return True


def text_of(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    source = fs.open(at)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def drop_path(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


SETS = ["organization_id", "repository_id"]


class ChunkSets:
    """Chunk sets by (organization_id, repository_id), replaced whole.

    ``data/commit=../org_bucket=..`` holds files that are never changed. A version is a file naming a manifest: a table
    (organization_id, repository_id, commit) of the commit that holds each set now. A reader takes the latest version once and sees
    every set old or new, whole. A commit is made from the version it read; when that isn't the latest any more, it raises Conflict
    and nothing changes, unless ``tries`` are left. On file systems whose rename may overwrite, writers need a lock of their own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        """``schema``: the columns of a row, with organization_id and repository_id."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), spark.createDataFrame([], schema).schema

    def version(self) -> int:
        return max((int(n) for n in names_in(self.spark, f"{self.path}/versions") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        sets = [f for f in self.schema if f.name in SETS]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(sets, key=lambda f: SETS.index(f.name))) + ", commit string"
        if not at:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(text_of(self.spark, f"{self.path}/versions/{at:012d}"))

    def read(self, version: int | None = None) -> DataFrame:
        """All sets of one version. Folders of commits that the manifest doesn't name are not opened."""
        manifest = self.manifest(version)
        if manifest.isEmpty():
            return self.spark.createDataFrame([], self.schema)
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        rows = self.spark.read.schema(types + ", commit string, org_bucket int").parquet(f"{self.path}/data")
        return rows.join(counted_small(manifest), [*SETS, "commit"], "left_semi").select(*self.schema.names)

    def replace(self, rows: DataFrame, sets: DataFrame | None = None, tries: int = 1) -> int:
        """Replace the sets named in ``sets`` (organization_id, repository_id) and in ``rows`` by ``rows``: a named set without rows becomes empty. The new version."""
        commit = uuid.uuid4().hex
        own = rows.select(*self.schema.names)
        own.withColumn("commit", F.lit(commit)).withColumn("org_bucket", tenant_bucket(F.col("organization_id"))).write.mode("append").partitionBy("commit", "org_bucket").parquet(f"{self.path}/data")
        filled = own.select(*SETS).distinct()
        named = filled if sets is None else filled.unionByName(sets.select(*SETS)).distinct()
        for left in range(tries - 1, -1, -1):
            base = self.version()
            kept = self.manifest(base).join(named, SETS, "left_anti")
            at = f"{self.path}/manifests/{uuid.uuid4().hex}"
            kept.unionByName(filled.withColumn("commit", F.lit(commit))).write.parquet(at)
            if self._take(base + 1, at):
                return base + 1
            drop_path(self.spark, at)
            if not left:
                drop_path(self.spark, f"{self.path}/data/commit={commit}")
        raise Conflict(f"version {base + 1} was taken")

    def _take(self, version: int, manifest: str) -> bool:
        return put_new(self.spark, f"{self.path}/versions/{version:012d}", manifest)

    def vacuum(self) -> list[str]:
        """Delete commits and manifests that the latest version doesn't need; readers of older versions must be done, and no writer at work."""
        latest = self.version()
        used = {r[0] for r in self.manifest(latest).select("commit").distinct().toLocalIterator()}
        gone = [n for n in names_in(self.spark, f"{self.path}/data") if n.startswith("commit=") and n[7:] not in used]
        for n in gone:
            drop_path(self.spark, f"{self.path}/data/{n}")
        for n in names_in(self.spark, f"{self.path}/versions"):
            if n.isdigit() and int(n) < latest:
                drop_path(self.spark, text_of(self.spark, f"{self.path}/versions/{n}"))
                drop_path(self.spark, f"{self.path}/versions/{n}")
        return gone


class LedgerSink:
    """A sink for micro-batches in which a batch that is run again leaves one copy.

    Rows of an epoch go to a folder of their own, and a ledger entry is made when they are whole. A batch whose entry is there is
    skipped; one that broke off before it is written over. Readers see entered epochs alone. ``stream`` names the query: epochs
    of a query that starts from a new checkpoint begin at 0 again, and need another name.
    """

    def __init__(self, spark: SparkSession, path: str, stream: str = "stream") -> None:
        self.spark, self.path, self.stream = spark, path.rstrip("/"), stream

    def __call__(self, df: DataFrame, epoch: int) -> None:
        entry = f"{self.path}/ledger/{self.stream}-{epoch:012d}"
        fs, at = _fs(self.spark, entry)
        if fs.exists(at):
            return
        folder = f"{self.path}/data/{self.stream}-{epoch:012d}"
        df.write.mode("overwrite").parquet(folder)
        put_new(self.spark, entry, folder)

    def read(self, schema) -> DataFrame:
        """All entered rows, of every stream."""
        folders = [f"{self.path}/data/{n}" for n in names_in(self.spark, f"{self.path}/ledger") if not n.startswith(".")]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

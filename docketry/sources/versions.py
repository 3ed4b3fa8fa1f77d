"""A table of stored documents that is replaced by key, one commit at a time.

Rows lie in partitions by kind and bucket of the key.  A commit rewrites the partitions that new rows touch into files
of its own and leaves all others where they are; then it writes a marker that names the files of every partition.  The
marker is moved into place last, and never over another: a reader sees the commit before or after, whole, and of two
writers that began from one version the second fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import cache_views

ROWS = "kind string, key string, ident string, fetched_at string, body binary"
#: Partitions of each kind.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed first."""


class Commits:
    """Markers ``commits/<version>.json`` of a table at ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._context = self._hadoop.FileContext.getFileContext(self._hadoop.Path(self.path).toUri(), spark._jsc.hadoopConfiguration())
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def version(self) -> int:
        """The last commit, 0 before the first."""
        folder = self._place("commits")
        if not self._files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()), default=0)

    def marker(self, version: int) -> dict:
        """What a version's marker says; it names folders, never rows."""
        if not version:
            return {}
        return json.loads(self.spark.read.option("wholetext", "true").text(f"{self.path}/commits/{version:012d}.json").first()["value"])

    def commit(self, version: int, marker: dict) -> None:
        """Write the marker beside its place and move it there, unless one is there already."""
        tmp, final = self._place("commits", f"{uuid.uuid4().hex}.tmp"), self._place("commits", f"{version:012d}.json")
        self._files.mkdirs(self._place("commits"))
        out = self._files.create(tmp, False)
        out.write(bytearray(json.dumps(marker, sort_keys=True).encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(tmp, final, options)
        except Exception as refused:
            self._files.delete(tmp, False)
            if self._files.exists(final):
                raise Conflict(f"version {version} was committed by another writer") from refused
            raise


class Versioned(Commits):
    """The table of stored documents at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        super().__init__(spark, path)
        self.buckets = buckets

    def _parts(self, version: int) -> dict[str, str]:
        """Folder of each partition ``kind/bucket`` in a version; as many as there are kinds times buckets at most."""
        return self.marker(version).get("parts", {})

    def read(self, version: int | None = None, kinds: list[str] | None = None) -> DataFrame:
        """All rows of a version, the last unless given; other kinds' partitions aren't listed where ``kinds`` is given."""
        parts = self._parts(self.version() if version is None else version)
        return self._rows([folder for part, folder in sorted(parts.items()) if kinds is None or part.split("/")[0] in kinds])

    def entries(self, wanted: list[tuple[str, str]], version: int | None = None) -> DataFrame:
        """Rows of the given kinds and keys; no partition but theirs is listed or read."""
        asked = self.spark.createDataFrame(wanted, "kind string, key string")
        parts = self._parts(self.version() if version is None else version)
        places = {f"{r['kind']}/{r['b']}" for r in asked.select("kind", self._bucket().alias("b")).distinct().collect()}
        return self._rows([parts[p] for p in sorted(places) if p in parts]).join(F.broadcast(asked.distinct()), ["kind", "key"], "left_semi")

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], ROWS)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets))

    def replace(self, rows: DataFrame, now: Column | None = None) -> int:
        """Commit ``rows(kind, key, ident, fetched_at, body)`` in place of those of the same kind and key; the new version.

        Of rows of one key the one fetched last stays.  With ``now`` search entries that have expired leave the
        partitions that are rewritten.  Without rows nothing is committed.
        """
        base = self.version()
        held, stamp = self._parts(base), uuid.uuid4().hex
        given = rows.select("kind", "key", "ident", "fetched_at", F.col("body").cast("binary").alias("body"))
        newest = F.max_by(F.struct("ident", "fetched_at", "body"), F.struct("fetched_at", "body"))
        new = given.groupBy("kind", "key").agg(newest.alias("r")).select("kind", "key", "r.*")
        # kinds times buckets at most
        touched = [f"{r['kind']}/{r['b']}" for r in given.select("kind", self._bucket().alias("b")).distinct().collect()]
        if not touched:
            return base
        old = self._rows([held[p] for p in touched if p in held])
        kept = old.join(new.select("kind", "key"), ["kind", "key"], "left_anti")
        both = kept.unionByName(new) if now is None else cache_views.evict(kept.unionByName(new), now)
        placed = both.select("*", F.col("kind").alias("k"), self._bucket().alias("b"))
        folder = f"data/{stamp}"
        placed.repartition("k", "b").write.partitionBy("k", "b").parquet(f"{self.path}/{folder}")
        written = {f"{p['k']}/{p['b']}": f"{folder}/k={p['k']}/b={p['b']}" for p in self._written(folder)}
        parts = {p: f for p, f in held.items() if p not in touched} | written
        self.commit(base + 1, {"version": base + 1, "parts": parts})
        return base + 1

    def _written(self, folder: str) -> list[dict[str, str]]:
        found = []
        for k in self._files.listStatus(self._place(folder)):
            if k.isDirectory():
                kind = k.getPath().getName().removeprefix("k=")
                found += [{"k": kind, "b": b.getPath().getName().removeprefix("b=")} for b in self._files.listStatus(k.getPath()) if b.isDirectory()]
        return found

    def vacuum(self, keep: int = 2) -> int:
        """Remove markers older than the last ``keep`` versions, then data that no marker names; how many folders went.

        Not to be run while a writer is at work: its data have no marker yet.
        """
        last = self.version()
        named: set[str] = set()
        for version in range(max(1, last - keep + 1), last + 1):
            named |= {f.split("/")[1] for f in self._parts(version).values()}
        for version in range(1, max(1, last - keep + 1)):
            self._files.delete(self._place("commits", f"{version:012d}.json"), False)
        data = self._place("data")
        gone = [s.getPath() for s in (self._files.listStatus(data) if self._files.exists(data) else []) if s.getPath().getName() not in named]
        return sum(bool(self._files.delete(p, True)) for p in gone)

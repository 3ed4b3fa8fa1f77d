"""Follow-up runs: searches repeated over overlapping windows, of which only families not seen before are new."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import present
from docketry.operators.hits import dedup_families
from docketry.sources.versions import Commits

KNOWN = "family_id string, batch string"
#: Folders of known families after which the next commit writes them anew as one.
FOLDERS = 32


class FollowUps(Commits):
    """Batches of hits and the families they made known, at ``path``, a folder that driver and executors share.

    A batch has an id and is done once: what it found, and the families known after it, are one commit.  A batch that
    comes again, after a failure or because a stream repeats it, gives the result it gave and changes nothing; one that
    failed before its commit left nothing behind that is read.
    """

    def known(self, version: int | None = None) -> DataFrame:
        """``family_id, batch``: families known in a version, the last unless given, and the batch that found each."""
        return self._families(self.marker(self.version() if version is None else version))

    def _families(self, marker: dict) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in marker.get("known", [])]
        return self.spark.read.schema(KNOWN).parquet(*folders) if folders else self.spark.createDataFrame([], KNOWN)

    def result(self, batch: str) -> DataFrame | None:
        """What a batch found, None if it isn't done."""
        folder = self.marker(self.version()).get("batches", {}).get(batch)
        return None if folder is None else self.spark.read.parquet(f"{self.path}/{folder}")

    def run(self, batch: str, hits: DataFrame) -> DataFrame:
        """Families of ``hits`` (see ``dedup_families``) with ``known``: whether a batch committed before had found them."""
        done = self.result(batch)
        if done is not None:
            return done
        base = self.version()
        marker = self.marker(base) or {"batches": {}, "known": []}
        stamp = uuid.uuid4().hex
        found, seen = f"data/{stamp}/found", f"data/{stamp}/known"
        dedup_families(hits, self._families(marker)).write.parquet(f"{self.path}/{found}")
        result = self.spark.read.parquet(f"{self.path}/{found}")
        new = result.where(~F.col("known") & present(F.col("family_id"))).select("family_id", F.lit(batch).alias("batch")).dropDuplicates(["family_id"])
        whole = len(marker["known"]) >= FOLDERS
        (self._families(marker).unionByName(new) if whole else new).write.parquet(f"{self.path}/{seen}")
        self.commit(base + 1, {"batches": marker["batches"] | {batch: found}, "known": [seen] if whole else [*marker["known"], seen]})
        return result

    def sink(self, frame: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: a micro-batch under its own id."""
        self.run(f"stream-{batch_id}", frame)

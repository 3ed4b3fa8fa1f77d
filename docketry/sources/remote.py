"""Upstream pages as a Spark data source with an injected transport.

Requests to one upstream are sequential by its terms, so a read is one partition; the result belongs in the bronze
table ``kind, key, ident, fetched_at, status, body``, from which everything else is read in parallel.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, key string, ident string, fetched_at string, status int, body string"


def register(spark: SparkSession, transport: Callable[[str, str], tuple[int, str]], clock: Callable[[], dt.datetime], name: str = "patent_upstream") -> None:
    """Make ``spark.read.format(name).option("kind", ...).option("idents", "a\\nb")`` call ``transport(kind, ident)``."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.kind, self.idents = options.get("kind", ""), [i for i in options.get("idents", "").split("\n") if i]

        def partitions(self):
            return [InputPartition(0)]

        def read(self, partition) -> Iterator[tuple]:
            for ident in self.idents:
                status, body = transport(self.kind, ident)
                yield self.kind, ident, ident, clock().isoformat(timespec="seconds"), status, body

    class Upstream(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Upstream)

"""Snapshots of the index: tables as versioned Parquet, and a pointer to the versions that hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import IndexMissing
from ..operators import querylog
from ..schema import APPENDED, TABLES
from .pointer import Pointer

#: Snapshots whose tables stay readable, for readers that began before the last ones.
KEPT = 3


class IndexStore:
    """Writes new versions of changed tables and then swaps the pointer, so that text, postings, vectors, hashes and relations change together.

    The query log and its marks are only appended to. A snapshot's tables go when KEPT newer ones
    are there.
    """

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, f"{home.rstrip('/')}/index"
        self.pointer = Pointer(spark, self.home)

    def exists(self) -> bool:
        return self.pointer.read()[1] is not None

    def create(self) -> None:
        if not self.exists():
            self.publish({})

    def versions(self) -> dict[str, str]:
        """Each table's folder."""
        _, now = self.pointer.read()
        if now is None:
            raise IndexMissing(f"no index in {self.home}: run a sync first")
        return dict(now)

    def table(self, name: str) -> DataFrame:
        path = self.versions().get(name)
        df = self.spark.createDataFrame([], TABLES[name]) if path is None else self.spark.read.schema(TABLES[name]).parquet(f"{self.home}/{path}")
        if name == "query_log":
            df = querylog.marked(df.unionByName(self.appended(name)), self.appended("follow_ups")).select(*df.columns)
        return df

    def publish(self, tables: dict[str, DataFrame]) -> None:
        """New versions of some tables, visible all at once; StoreConflict if another writer was first."""
        number, now = self.pointer.read()
        now = dict(now or {})
        for name, df in tables.items():
            path = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.home}/{path}")
            now[name] = path
        self.pointer.swap(now, number)
        old, kept = self.pointer.drop_before(KEPT)
        for path in {p for v in old for p in v.values()} - {p for v in kept for p in v.values()}:
            self.pointer.remove(path)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table that only grows."""
        rows.coalesce(1).write.mode("append").parquet(f"{self.home}/{APPENDED}-{name}")

    def appended(self, name: str) -> DataFrame:
        if not self.pointer.listed(f"{APPENDED}-{name}"):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.home}/{APPENDED}-{name}")

    def manifest(self, key: str) -> str | None:
        row = self.table("manifest").where(f"key = '{key}'").first()
        return row.value if row else None

    def with_manifest(self, key: str, value: str) -> DataFrame:
        new = self.spark.createDataFrame([(key, value)], TABLES["manifest"])
        return self.table("manifest").where(f"key <> '{key}'").unionByName(new)

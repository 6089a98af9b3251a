"""State tables that last: snapshots in a shared folder, a new one for each change, the newest whole one counts.

A snapshot is written under a new number; Spark's success mark makes it count, so that a change that breaks off leaves the table as it was,
and a run that starts again goes on from there. Older snapshots than the last KEPT go.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import schemas
from docspark.operators import state

KEPT = 2
TABLES = {"pages": schemas.PAGES, "images": schemas.IMAGES, "runs": schemas.RUNS}
KEYS = {"pages": "url", "images": "url", "runs": "id"}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def versions(self, table: str) -> list[int]:
        """Numbers of the whole snapshots, in order."""
        at = self._path(f"{self.root}/{table}")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        found = [int(n[2:]) for n in names if re.fullmatch(r"v=\d+", n)]
        return sorted(v for v in found if self.fs.exists(self._path(f"{self.root}/{table}/v={v}/_SUCCESS")))

    def read(self, table: str) -> DataFrame:
        """The table in its present form; older snapshots grow the columns they lack. Empty before the first write."""
        found = self.versions(table)
        if not found:
            return self.spark.createDataFrame([], TABLES[table])
        return schemas.grown(self.spark.read.parquet(f"{self.root}/{table}/v={found[-1]}"), TABLES[table])

    def write(self, table: str, rows: DataFrame) -> None:
        found = self.versions(table)
        new = found[-1] + 1 if found else 0
        schemas.grown(rows, TABLES[table]).write.mode("overwrite").parquet(f"{self.root}/{table}/v={new}")
        for v in found[: 1 - KEPT or None]:
            self.fs.delete(self._path(f"{self.root}/{table}/v={v}"), True)

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows take the place of those with their key, the rest stay; of rows with one key the largest counts."""
        key = KEYS[table]
        new = schemas.grown(rows, TABLES[table])
        new = new.groupBy(key).agg(F.max(F.struct(*(c for c in new.columns if c != key))).alias("_r")).select(key, "_r.*").select(new.columns)
        self.write(table, self.read(table).join(new.select(key), key, "left_anti").select(new.columns).union(new))

    def insert_new(self, table: str, rows: DataFrame, order: str) -> None:
        """Rows whose key is not known yet, the first of each key by order."""
        fresh = state.insert_new(self.read(table), rows, KEYS[table], order)
        self.write(table, self.read(table).unionByName(schemas.grown(fresh, TABLES[table])))

    def fold_pages(self, events: DataFrame) -> None:
        self.write("pages", state.fold(self.read("pages"), events))

    def set_titles(self, titles: DataFrame) -> None:
        """titles(url, title): known pages get their title; empty ones and unknown pages do nothing."""
        new = titles.where("coalesce(title, '') <> ''").groupBy("url").agg(F.max("title").alias("_t"))
        pages = self.read("pages")
        self.write("pages", pages.join(new, "url", "left").withColumn("title", F.coalesce("_t", "title")).select(pages.columns))

    def clear(self, *tables: str) -> None:
        """Empties the given tables, or all."""
        for table in tables or TABLES:
            self.write(table, self.read(table).limit(0))

    def find(self, table: str, key) -> DataFrame:
        """The row of a key, or none."""
        return self.read(table).where(F.col(KEYS[table]) == F.lit(key))

    def has_any(self, table: str) -> bool:
        return not self.read(table).limit(1).isEmpty()

    def start_run(self, now: Column) -> int:
        """A new run's number, one above the last."""
        last = self.read("runs").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self.upsert("runs", self.spark.range(1).select(F.lit(last + 1).cast("long").alias("id"), now.alias("started_at")))
        return last + 1

    def finish_run(self, run: int, now: Column) -> None:
        self.write("runs", state.finished_run(self.read("runs"), run, state.run_statistics(self.read("pages"), self.read("images")), now))

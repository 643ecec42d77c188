"""Versioned Parquet tables in buckets: a batch writes the buckets that its keys fall into, then a pointer moves.

A version's pointer is a file that names, for each bucket, the version that holds it. Readers
see what the newest pointer names; a failed or repeated write leaves only unnamed folders.
The cost of a batch follows from the buckets it touches, not from the table's history. Paths
go through Hadoop's file system, so any store will do that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.schema import unused


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "session_id", buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def version(self) -> int:
        """The newest pointer; -1 before the first write."""
        found = [-1]
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("current-"):
                found.append(int(name.removeprefix("current-")))
        return max(found)

    def held(self, version: int) -> dict[int, int]:
        """Of each bucket that has rows, the version that wrote it."""
        if version < 0:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/current-{version}"))
        try:
            return {int(b): v for b, v in json.loads(stream.readLine()).items()}
        finally:
            stream.close()

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        paths = [f"{self.path}/v{v}/bucket={b}" for b, v in sorted(self.held(self.version()).items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, buckets: list[int] | None = None) -> int:
        """The next version, in which ``buckets`` (all, if None) hold ``rows``; of two writers of one version the second fails."""
        last = self.version()
        v, mine = last + 1, range(self.buckets) if buckets is None else buckets
        name = unused(rows, "bucket")
        placed = rows.select(*self.read([]).columns).withColumn(name, self.bucket(F.col(self.key)))
        # one file a bucket and writing task: rows of a bucket meet in one task
        placed.withColumnRenamed(name, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{v}")
        held = {b: w for b, w in self.held(last).items() if b not in mine}
        held |= {b: v for b in mine if self._fs.exists(self._path(f"{self.path}/v{v}/bucket={b}"))}
        try:
            stream = self._fs.create(self._path(f"{self.path}/current-{v}"), False)
        except Exception as error:
            raise RuntimeError(f"version {v} was written by another job") from error
        stream.writeBytes(json.dumps(held))
        stream.close()
        return v

    def replace(self, rows: DataFrame) -> int:
        return self.write(rows)

    def merge(self, rows: DataFrame, seen: DataFrame | None = None) -> int:
        """Rows replace all that has the keys of ``seen`` (of the rows, if None); other buckets are not read."""
        keys = (rows if seen is None else seen).select(self.key).distinct()
        mine = self.touched(keys)
        kept = self.read(mine).join(keys, self.key, "left_anti")
        columns = self.read([]).columns
        return self.write(kept.select(*columns).unionByName(rows.select(*columns)), mine)

    def vacuum(self, keep: int = 2) -> None:
        """Drop pointers before the last ``keep``, and folders that none of the others names."""
        last = self.version()
        named = {v for n in range(max(0, last - keep + 1), last + 1) for v in self.held(n).values()}
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            old_pointer = name.startswith("current-") and int(name.removeprefix("current-")) <= last - keep
            old_folder = name.startswith("v") and name[1:].isdigit() and int(name[1:]) <= last and int(name[1:]) not in named
            if old_pointer or old_folder:
                self._fs.delete(status.getPath(), True)

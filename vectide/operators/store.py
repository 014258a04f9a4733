"""A store of vector records in Parquet: append, upsert, delete, compact, snapshot, back up.

Rows: id, version and whatever else; the current row of an id is that of the highest version. A write goes to a hidden
folder, which gets its name, `state-<number>-...`, when it is whole, so that readers never see half a table and a failed
job leaves the old state. The state with the largest number is the current one; numbers are never used again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The record's canonical columns.
RECORD = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("values", T.ArrayType(T.FloatType())), T.StructField("metadata_source", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("owner", T.StringType()), T.StructField("permissions", T.ArrayType(T.StringType())), T.StructField("category", T.StringType()),
    T.StructField("score", T.FloatType()), T.StructField("status", T.StringType()), T.StructField("custom", T.StringType()), T.StructField("shard", T.StringType()),
    T.StructField("replicas", T.ArrayType(T.StringType())), T.StructField("version", T.IntegerType()), T.StructField("deleted", T.BooleanType()),
])


def latest(df: DataFrame, key: str = "id", order: Sequence[str] = ("version",)) -> DataFrame:
    """The last row of each key. Window with a limit per key: at most one row a key and task is shuffled on."""
    w = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def live(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("deleted", F.lit(False)))


def upsert(base: DataFrame, changes: DataFrame, key: str = "id", order: Sequence[str] = ("version",)) -> DataFrame:
    """Last write wins by order."""
    return latest(base.unionByName(changes, allowMissingColumns=True), key, order)


def update(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of existing keys replaced; keys that are not there are not added."""
    hit = changes.join(base.select(key), key, "left_semi")
    return base.join(changes.select(key), key, "left_anti").unionByName(hit, allowMissingColumns=True)


def delete(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def soft_delete(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    marked = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    return base.join(marked, key, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)) | F.coalesce("_gone", F.lit(False))).drop("_gone")


def needs_compaction(df: DataFrame, ratio: float = 0.2, least: int = 10) -> DataFrame:
    """One row: total, deleted, due."""
    gone = F.count_if(F.coalesce("deleted", F.lit(False)))
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), gone.alias("deleted"), ((n >= least) & (gone / n >= ratio)).alias("due"))


def changed(before: DataFrame, after: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """(key, version, change): added, updated or removed since an earlier state, for incremental copies."""
    a, b = before.select(key, F.col(version).alias("_old")), after.select(key, version)
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col(version).isNull(), "removed").when(F.col(version) != F.col("_old"), "updated")
    return both.select(key, version, kind.alias("change")).where("change is not null")


def checksum(columns: Sequence[str]) -> Column:
    """Of one row; a table's is the sum of these modulo 2**31, whatever its order."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31))


def integrity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, distinct ids, checksum."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.pmod(F.sum(checksum(columns).cast("decimal(20,0)")), F.lit(1 << 31)).cast("bigint").alias("checksum"))


class Store:
    """One table under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def snapshots(self) -> list[str]:
        """Names of the states, oldest first."""
        fs, path = self._fs(self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("state-")) if fs.exists(path) else []

    def read(self, name: str | None = None) -> DataFrame:
        names = self.snapshots()
        if not names:
            raise FileNotFoundError(f"nothing stored in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{name or names[-1]}")

    def write(self, df: DataFrame, files: int | None = None) -> str:
        """A new state; it counts from the moment its folder has its final name."""
        hidden = f"{self.folder}/_new-{uuid.uuid4().hex}"
        (df.coalesce(files) if files else df).write.parquet(hidden)
        name = f"state-{self._claim():08d}-{uuid.uuid4().hex[:8]}"
        fs, source = self._fs(hidden)
        if not fs.rename(source, self._fs(f"{self.folder}/{name}")[1]):
            raise OSError(f"cannot publish {name}")
        return name

    def _claim(self) -> int:
        """The next number. An empty file marks it as taken: of two writers, one fails to create it and goes on."""
        fs, folder = self._fs(f"{self.folder}/_taken")
        fs.mkdirs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] + [n.split("-")[1] for n in self.snapshots()]
        number = max((int(n) for n in names if n.isdigit()), default=-1) + 1
        while not fs.createNewFile(self._fs(f"{self.folder}/_taken/{number:08d}")[1]):
            number += 1
        return number

    def restore(self, name: str) -> str:
        return self.write(self.read(name))

    def verify(self, name: str, columns: Sequence[str], expected: DataFrame) -> bool:
        """Whether a state holds the same rows as `expected`."""
        return integrity(self.read(name), columns).first() == integrity(expected, columns).first()

    def compact(self, files: int | None = None) -> str:
        return self.write(live(self.read()), files)

    def keep(self, newest: int) -> list[str]:
        """Drop all but the newest states; gives the names dropped."""
        gone = self.snapshots()[: -newest or None]
        for name in gone:
            fs, path = self._fs(f"{self.folder}/{name}")
            fs.delete(path, True)
        return gone

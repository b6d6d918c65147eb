"""Keyed tables in hashed buckets, with a version of each bucket for every batch that touched it.

A batch writes only the buckets that its keys fall into, under ``<table>/version=<batch>/bucket=<n>``, and then a
manifest under ``<group>/batch=<batch>``: which version of which bucket makes up the tables from now on. The manifest is
the commit. Readers take the buckets it names, and of these only those they ask for. A batch starts from the manifest of
the batch before it, so a batch that is run again writes the same files again, and bytes written grow with the buckets
that a batch touches, not with the tables.

What reaches the driver are bucket numbers and versions: at most one row for each bucket of each table, whatever is in
them. The number of buckets is part of the manifest; opening a state with another number is an error.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "name string, bucket int, version long, buckets int"
Versions = dict[str, dict[int, int]]


def _hadoop_path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers ``n`` of the sub-folders ``<prefix><n>``; none where the folder is not there."""
    path, files = _hadoop_path(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def deleted(spark: SparkSession, folder: str) -> None:
    path, files = _hadoop_path(spark, folder)
    files.delete(path, True)


@dataclass(frozen=True)
class BucketedTable:
    """A table under ``folder``: its schema (DDL) and the column whose hash decides the bucket."""

    folder: str
    name: str
    schema: str
    key: str
    buckets: int = 64

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    def bucket(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame, key: str | None = None) -> set[int]:
        """Buckets of the keys: at most as many numbers as there are buckets."""
        return {r[0] for r in keys.select(self.bucket(key or self.key).alias("b")).distinct().collect()}

    def read(self, spark: SparkSession, versions: Versions, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of the named buckets (all where ``only`` is None) in the versions of a manifest."""
        held = versions.get(self.name, {})
        wanted = held if only is None else sorted(set(only) & held.keys())
        paths = [f"{self.folder}/{self.name}/version={held[b]}/bucket={b}" for b in wanted]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, batch: int, touched: set[int], versions: Versions) -> Versions:
        """Writes ``rows``, all that the touched buckets hold from now on; gives the versions with them."""
        spark, folder = rows.sparkSession, f"{self.folder}/{self.name}/version={batch}"
        own = {b: v for b, v in versions.get(self.name, {}).items() if b not in touched}
        if touched:
            dealt = rows.select(*self.columns, self.bucket().alias("bucket")).hint("rebalance", "bucket")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)
            found = set(listed(spark, folder, "bucket="))
            if found - touched:
                raise ValueError(f"{self.name}: rows of buckets that were not read: {sorted(found - touched)[:5]}")
            own |= dict.fromkeys(found, batch)
        return versions | {self.name: own}


def read_manifest(spark: SparkSession, folder: str, group: str, batch: int, buckets: int) -> Versions:
    """Versions after ``batch``. Only batch -1, before the first, is empty: a manifest missing later is lost data, and
    reading it raises."""
    if batch < 0:
        return {}
    out: Versions = {}
    for r in spark.read.schema(MANIFEST).parquet(f"{folder}/{group}/batch={batch}").collect():
        if r["buckets"] != buckets:
            raise ValueError(f"{r['name']} has {r['buckets']} buckets, not {buckets}")
        out.setdefault(r["name"], {})[r["bucket"]] = r["version"]
    return out


def write_manifest(spark: SparkSession, folder: str, group: str, batch: int, versions: Versions, buckets: int) -> None:
    rows = [(name, b, v, buckets) for name, held in versions.items() for b, v in held.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{group}/batch={batch}")


def last_batch(spark: SparkSession, folder: str, group: str) -> int:
    """The last batch that was committed; -1 where there is none."""
    done = [n for n in listed(spark, f"{folder}/{group}", "batch=")]
    while done:
        path, files = _hadoop_path(spark, f"{folder}/{group}/batch={done[-1]}/_SUCCESS")
        if files.exists(path):
            return done[-1]
        done.pop()
    return -1


def vacuum(spark: SparkSession, tables: list[BucketedTable], group: str, keep: int = 2) -> int:
    """Deletes bucket versions that none of the last ``keep`` manifests names, and older manifests; gives their number.
    With two kept, the last batch can still be run again."""
    folder, buckets = tables[0].folder, tables[0].buckets
    last = last_batch(spark, folder, group)
    kept = [read_manifest(spark, folder, group, n, buckets) for n in range(max(0, last - keep + 1), last + 1)]
    gone = 0
    for table in tables:
        named = {(v, b) for m in kept for b, v in m.get(table.name, {}).items()}
        for version in listed(spark, f"{folder}/{table.name}", "version="):
            if version > last:
                continue
            held = listed(spark, f"{folder}/{table.name}/version={version}", "bucket=")
            old = [b for b in held if (version, b) not in named]
            for b in old:
                deleted(spark, f"{folder}/{table.name}/version={version}/bucket={b}")
            gone += len(old)
            if len(old) == len(held):
                deleted(spark, f"{folder}/{table.name}/version={version}")
    for n in listed(spark, f"{folder}/{group}", "batch="):
        if n <= last - keep:
            deleted(spark, f"{folder}/{group}/batch={n}")
    return gone

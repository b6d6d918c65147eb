"""Helpers that the corpus operators share: scratch tables, tiny Arrow utilities."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a temporary folder serves sessions on one machine, as in tests; on a cluster that
    would lose data, so it is an error there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quaywise-")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/quaywise/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors.

    Nothing reads the write's shuffle files once the table is there, so Spark is told to drop them at its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`written` returned, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Size of a :func:`hashed_bits` filter, whatever the table: a megabyte.
FILTER_BITS = 1 << 23


def hashed_bits(keys: DataFrame, key: str) -> np.ndarray:
    """A filter of :data:`FILTER_BITS` bits over a column of 64-bit hashes, for :func:`may_hold`. Words of 64 bits are
    put together by Spark; at most 131 072 of them reach the driver. With more keys it lets more through, never less."""
    place = F.pmod(F.col(key), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))")
    words = keys.groupBy(F.floor(place / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for w, bits in words:
        out[w] = bits & 0xFFFF_FFFF_FFFF_FFFF
    return out


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False where a hash is certainly not among the keys of the filter."""
    place = hashes.astype(np.int64) % FILTER_BITS
    return (bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def may_be_in(bits: np.ndarray, key: Column) -> Column:
    """:func:`may_hold` as a column."""

    @F.pandas_udf("boolean")
    def held(hashes: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits, hashes.to_numpy()))

    return held(key)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that a batch of long texts never sits in Python twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as keep it apart from the columns of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""Tables that are written once and read by many queries: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset in a session on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quaywise-"))
    return _LOCAL[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again."""
    path = f"{shared_folder(df.sparkSession)}/quaywise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of a data folder, written at its first use in an application."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _KEPT:
        _KEPT[key] = stored(build(), name)
    return _KEPT[key]

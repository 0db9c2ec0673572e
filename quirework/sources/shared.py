"""Tables in the folder that driver and executors share: written results, and results kept for a source's present files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where the session names none and runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quirework-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: cuts lineage, survives lost executors, and is computed once however often it is read."""
    path = f"{folder(df.sparkSession)}/quirework/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(table: DataFrame) -> tuple:
    """Number, bytes, latest change and names (hashed) of the files that a table is read from: one row comes back."""
    m = F.col("_metadata")
    files = table.select(m["file_path"].alias("p"), m["file_size"].alias("s"), m["file_modification_time"].alias("t")).distinct()
    return tuple(files.agg(F.count(F.lit(1)), F.sum("s"), F.max("t").cast("string"), F.sum(F.xxhash64("p").cast("decimal(38,0)")).cast("string")).first())


_kept: dict[tuple, object] = {}


def kept(table: DataFrame, name: str, make: Callable[[], object]):
    """What ``make`` gave for this table's present files in this application, made when first asked for."""
    key = (table.sparkSession.sparkContext.applicationId, folder(table.sparkSession), name, stamp(table))
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]

"""What the operators of this subpackage share: shared-folder tables, tokenizer files, text constants."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


class _Made(threading.local):
    """Places of the tables that :func:`saved` wrote in this thread and nobody deleted, oldest first."""

    def __init__(self):
        self.places: list[str] = []


_made = _Made()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/quirework/{name}-{uuid.uuid4().hex}"
    _made.places.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, place: str) -> None:
    if getattr(spark, "_jvm", None) is None:  # a remote session: the folder's owner clears it
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*frames: DataFrame) -> None:
    """Delete the tables of :func:`saved` once nothing reads them any more."""
    for df in frames:
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            name = f.rsplit("/", 1)[1]
            _made.places[:] = [p for p in _made.places if not p.endswith(name)]
            _delete(df.sparkSession, f)


def mark() -> int:
    """A point in time for :func:`sweep`: how many tables there are."""
    return len(_made.places)


def sweep(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete every table that this thread made after ``since`` whose name does not start with one of ``keep``.

    A query's result is lazy and reads its last tables, so only who has written that result can call this.
    """
    for place in _made.places[since:]:
        if not place.rsplit("/", 1)[1].startswith(keep or ("\0",)):
            _delete(spark, place)
            _made.places.remove(place)


def unused(name: str, taken: list[str]) -> str:
    """``name``, or ``name`` with underscores, as no column of ``taken`` is called (case does not tell names apart)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on the machine that asks (each executor asks for itself)."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Most rows and bytes of one Arrow batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Hand Python few rows and few bytes at a time, so that long texts (or tiles) do not pile up in one Arrow batch.

    Plans are lazy, so a setting cannot be put back before they run.  So there is one pair of values for all
    operators, and only what the session leaves unset is set.
    """
    for key, value in BATCHES.items():
        if not spark.conf.get(key, None):
            spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")

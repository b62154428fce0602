"""Reading nested wire batches from files, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.schemas import BATCHES

BAD_LINE = "_corrupt_record"


def parsed(lines: DataFrame, signal: str, text: str = "value") -> DataFrame:
    """JSON text parsed with the signal's schema; unreadable lines keep their text in ``_corrupt_record``."""
    schema = f"{BATCHES[signal]}, {BAD_LINE} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    others = [c for c in lines.columns if c != text]
    rows = lines.withColumn("_batch", F.from_json(F.col(text), schema, options))
    return rows.select(*others, "_batch.*")


def is_readable() -> Column:
    return F.col(BAD_LINE).isNull() & F.col("tenant_id").isNotNull()


def _json(reader, signal: str):
    return reader.schema(f"{BATCHES[signal]}, {BAD_LINE} string").option("columnNameOfCorruptRecord", BAD_LINE)


def read_batches(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """JSON-lines files of one signal."""
    return _json(spark.read, signal).json(path)


def read_batches_parquet(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """Parquet files holding the same nested rows."""
    return spark.read.schema(BATCHES[signal]).parquet(path)


def stream_batches(spark: SparkSession, path: str, signal: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same JSON-lines files as a stream."""
    reader = _json(spark.readStream, signal)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)

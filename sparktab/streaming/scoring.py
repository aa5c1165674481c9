"""Score files as they arrive with the same projections as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.bundle import Bundle

BATCH_ONLY = ("ffill", "bfill", "interpolate", "knn")


def score_stream(bundle: Bundle, arriving: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lazy scored stream.  Steps that need the whole table are refused; ``shrink`` uses fit-time bounds."""
    imputer = bundle.chain.config.imputer.partition(":")[0]
    if imputer in BATCH_ONLY:
        raise ValueError(f"imputer {imputer!r} needs the whole table and cannot run on a stream")
    return bundle.predict_labels(arriving, keep, batch_bounds=False)


def start_scoring(
    spark: SparkSession, bundle: Bundle, schema: StructType, source: str, sink: str, checkpoint: str,
    keep: tuple[str, ...] = (), kind: str = "csv", available_now: bool = True, files_per_batch: int = 1_000,
) -> StreamingQuery:
    """Read new files under ``source`` and append decisions to ``sink``; progress lives in ``checkpoint``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if kind == "csv":
        reader = reader.option("header", True)
    arriving = reader.format(kind).load(source)
    writer = score_stream(bundle, arriving, keep).drop("probability").writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Scoring new library files as they arrive (the batch scoring operator on a file stream).

The reference has no streaming; its scoring is append-only per image, so the same
operator runs unchanged on a ``readStream`` file source: the prompt table is
static and broadcast (size-checked), each micro-batch is scored by the Arrow
matrix product, and results are appended to a parquet sink whose checkpoint
sits in the session's shared checkpoint folder (restart-safe, exactly-once
file sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vecsight.constants import ALL_MEASURES
from vecsight.operators.scoring import score_library
from vecsight.sources.files import shared_dir


def library_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                   max_files_per_trigger: int = 64) -> DataFrame:
    """New parquet files of an embedding library folder, as a stream."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def start_scoring(stream: DataFrame, prompts: DataFrame, id_cols: list[str], out_path: str,
                  name: str, measures: tuple = ALL_MEASURES, emb_col: str = "embedding",
                  trigger_once: bool = False) -> StreamingQuery:
    """Append the long score table of every new library row to ``out_path``."""
    scores = score_library(stream, prompts, id_cols, emb_col=emb_col, measures=measures)
    ckpt = shared_dir(stream.sparkSession, "streams", name, "checkpoint")
    w = scores.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start(out_path)

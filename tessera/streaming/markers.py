"""Open-task markers of files as they arrive: the batch scan, run over new Parquet files only.

An extra beside the batch operators. The scan keeps no state, so a run takes what has arrived since
the last one, appends its markers and stops; the checkpoint remembers which files were read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import markers


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_markers(files: DataFrame, target: str, checkpoint: str, key: str = "file_path", text: str = "text", tags: Sequence[str] = T.MARKERS) -> StreamingQuery:
    """Starts one run over what is new; ``awaitTermination`` waits for its end."""
    found = markers.scan(files, key, text, tags)
    return found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)

"""A folder that is watched: new files are converted as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.sources.engine import MAX_INPUT, convert_documents, within

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str, files_per_batch: int = 1000, limit: int = MAX_INPUT) -> DataFrame:
    """A stream of (path, length, content), content null over the limit. No state is kept but the names that Spark has seen."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)
    return within(stream, limit)


def convert_stream(files: DataFrame, table_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Results of each micro-batch as Parquet below table_path/batch=N. A batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        convert_documents(batch).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

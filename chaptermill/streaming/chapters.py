"""The row-wise operators as a stream: files that arrive are numbered and checked as they come.

Every text is one row, so no state is kept over batches and none can be lost; a restart goes
on from the query's checkpoint. This is another way to run the operators, not another result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import markdown as M


def markdown_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """A stream of Parquet files of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def checked(df: DataFrame, key: str, markdown: str, chapter: str) -> DataFrame:
    """(key, markdown numbered, warnings) of a stream or a table."""
    return df.select(key, M.renumbered(F.col(markdown), F.col(chapter)).alias("markdown"), M.warnings(F.col(markdown)).alias("warnings"))


def unique(df: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """A stream without repeated rows of one key; a repeat that comes later than `late` after it counts anew."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def written(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there and ends; checkpoint has to be a folder that outlives the cluster."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Files that arrive in a folder, decoded as a stream.

The maps are stateless, so the plans of the batch readers run unchanged on each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, pattern: str = "*", per_trigger: int = 100) -> DataFrame:
    """A stream of (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of documents' pages."""
    from ..sources.images import pages as decode

    return decode(watch(spark, folder))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of images."""
    from ..sources.images import images as decode

    return decode(watch(spark, folder))


def convert_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, options=None) -> StreamingQuery:
    """Converts what arrives and saves the outputs; a batch that is run again writes the same files."""
    from ..plans.convert import Options, apart, convert
    from ..sinks.files import save

    def batch(df: DataFrame, _: int) -> None:
        save(apart(convert(df, options or Options()).where("error IS NULL")), out)

    return watch(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()

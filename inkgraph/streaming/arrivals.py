"""Files as they arrive: an extension, the same pages from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.images import pages_of


def arriving_pages(spark: SparkSession, path: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of pages of the files that arrive below a folder; stateless, so it needs no watermark."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return pages_of(files.select("path", "content"))

"""Books as they arrive in a folder, and running tallies of results; an extension beyond batch runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.reader import read_books


def stream_books(spark: SparkSession, folder: str, with_data: bool = False) -> DataFrame:
    """A stream of books read from files that appear below ``folder``; each file is read once."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{azw3,azw,mobi,prc,epub,cbz,fb2,zip,txt,html,htm,xhtml}").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return read_books(files, with_data)


def stream_tally(results: DataFrame, late: str = "10 days", window: str = "1 day") -> DataFrame:
    """Outcomes by day of start over a stream of results (conv_id, outcome, started_at); repeats within the allowed lateness count once."""
    once = results.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["conv_id"])
    return once.groupBy(F.window("started_at", window).alias("w"), "outcome").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "outcome", "n")


def write_stream(books: DataFrame, out: str, checkpoint: str):
    """Appends the stream to a parquet table and ends when what is there is read."""
    return books.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

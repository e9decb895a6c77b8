"""Extraction over streams of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandfold.operators.extract import extract

__all__ = ["extract_stream", "read_stream"]

READ = "read_ord long, qname string, descr string, seq string, qual string"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of reads kept as Parquet; files that appear in the folder are taken as they come."""
    return spark.readStream.schema(READ).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def extract_stream(reads: DataFrame, pattern: str, out: str, checkpoint: str, **options):
    """Start a query that extracts barcodes (no state is kept) and appends Parquet, each input file exactly once."""
    return extract(reads, pattern, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

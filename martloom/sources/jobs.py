"""Export job records kept as JSON documents."""

from pyspark.sql import DataFrame, SparkSession

from martloom import schemas


def read_jobs(spark: SparkSession, folder: str, one_per_file: bool = True) -> DataFrame:
    """Job records of a folder and those below it; many small files may be merged into line-delimited ones."""
    return (
        spark.read.schema(schemas.EXPORT_JOBS)
        .option("multiLine", one_per_file)
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
        .json(folder)
    )

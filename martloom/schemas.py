"""Column layouts of the mart metadata tables, the run ledger and the export jobs."""

from pyspark.sql import DataFrame, functions as F, types as T

MART_FILES = T.StructType([
    T.StructField("dataset_name", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("partition_start", T.DateType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("last_build_id", T.StringType()),
])

MART_SOURCES = T.StructType([
    T.StructField("dataset_name", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("raw_table_name", T.StringType()),
    T.StructField("source_root", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("file_count", T.LongType()),
    T.StructField("min_partition_start", T.DateType()),
    T.StructField("max_partition_start", T.DateType()),
    T.StructField("last_build_id", T.StringType()),
    T.StructField("refresh_mode", T.StringType()),
    T.StructField("last_refreshed_at", T.TimestampNTZType()),
])

MART_DATASETS = T.StructType([
    T.StructField("dataset_name", T.StringType()),
    T.StructField("source_count", T.LongType()),
    T.StructField("total_rows", T.LongType()),
    T.StructField("total_files", T.LongType()),
    T.StructField("min_partition_start", T.DateType()),
    T.StructField("max_partition_start", T.DateType()),
    T.StructField("last_refreshed_at", T.TimestampNTZType()),
])

RUNS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("pipeline_name", T.StringType()),
    T.StructField("execution_date", T.DateType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("trigger_type", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

STEPS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("pipeline_run_id", T.StringType()),
    T.StructField("step_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("records_processed", T.LongType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

EXPORT_JOBS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("action_key", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("expires_at", T.TimestampNTZType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("artifact_path", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("error_message", T.StringType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to ``schema``; a missing column raises at analysis time."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

"""The driver tables and the mart and ledger tables derived from them."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.functions.dates import month_start


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(df: DataFrame, dataset: str, source: str, key: str, part, build: str) -> DataFrame:
    month = F.col("partition_start")
    return (
        df.groupBy(month_start(F.col(key)).alias("partition_start"), part.cast("string").alias("_part"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            F.lit(dataset).alias("dataset_name"),
            F.lit(source).alias("source_name"),
            month,
            F.concat(
                F.lit(f"{source}/year="),
                F.year(month).cast("string"),
                F.lit("/month="),
                F.lpad(F.month(month).cast("string"), 2, "0"),
                F.lit("/part"),
                F.col("_part"),
            ).alias("file_path"),
            "row_count",
            F.lit(build).alias("last_build_id"),
        )
    )


def mart_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per logical file: orders by month, line items and events by month and kind."""
    orders = _files(table(spark, sf_dir, "orders"), "sales", "ORDERS", "o_orderdate", F.lit("0"), "build-001")
    lines = _files(
        table(spark, sf_dir, "lineitem"), "sales", "LINEITEM", "l_shipdate", F.col("l_linestatus"), "build-002"
    )
    events = _files(table(spark, sf_dir, "events"), "web", "EVENTS", "ts", F.col("event_type"), "build-003")
    return orders.unionByName(lines).unionByName(events)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pipeline run per order; the order priority is the pipeline."""
    key = F.col("o_orderkey")
    started = F.col("o_orderdate") + F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)"))
    status = (
        F.when(key % 10 == 0, "queued")
        .when(F.col("o_orderstatus") == "F", "success")
        .when(F.col("o_orderstatus") == "O", "running")
        .otherwise("failed")
    )
    finished = F.col("started_at") + F.make_dt_interval(secs=F.col("_seconds").cast("decimal(18,6)"))
    return (
        table(spark, sf_dir, "orders")
        .select(
            key.cast("string").alias("id"),
            F.col("o_orderpriority").alias("pipeline_name"),
            F.col("o_orderdate").cast("date").alias("execution_date"),
            status.alias("status"),
            started.alias("started_at"),
            (key % 7200).alias("_seconds"),
            F.when(key % 3 == 0, "scheduled").when(key % 3 == 1, "manual").otherwise("backfill").alias("trigger_type"),
        )
        .select(
            "id",
            "pipeline_name",
            "execution_date",
            "status",
            "started_at",
            F.when(F.col("status").isin("success", "failed"), finished).alias("finished_at"),
            "trigger_type",
            F.col("started_at").alias("created_at"),
        )
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step per (order, line number), started a minute apart after its run."""
    # "The greatest flag is R", counted so that the aggregate stays a hash aggregate.
    flag = F.col("l_returnflag")
    greatest_is_r = (F.count_if(flag == "R") > 0) & (F.count_if(flag > "R") == 0)
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", F.col("l_linenumber").alias("_n"))
        .agg(
            F.when(greatest_is_r, "failed").otherwise("success").alias("status"),
            F.sum("l_quantity").cast("long").alias("records_processed"),
            (F.count(F.lit(1)) - 1).cast("int").alias("retry_count"),
        )
        .withColumn("pipeline_run_id", F.col("l_orderkey").cast("string"))
    )
    heads = runs(spark, sf_dir).select(F.col("id").alias("pipeline_run_id"), F.col("started_at").alias("_run_start"))
    offset = (F.col("_n") - 1) * 60

    def after(seconds):
        return F.col("_run_start") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))

    name = F.concat(F.lit("step_"), F.col("_n").cast("string"))
    return lines.join(heads, "pipeline_run_id").select(
        F.concat_ws("/", "pipeline_run_id", name).alias("id"),
        "pipeline_run_id",
        name.alias("step_name"),
        "status",
        after(offset).alias("started_at"),
        after(offset + F.col("records_processed")).alias("finished_at"),
        "records_processed",
        F.when(F.col("status") == "failed", F.concat(F.lit("step "), F.col("_n").cast("string"), F.lit(" failed"))).alias(
            "error_message"
        ),
        "retry_count",
        after(offset).alias("created_at"),
    )


def _priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(name).distinct().withColumn("_digit", F.substring(name, 1, 1))


def pipeline_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configured pipeline per order priority."""
    digit = F.col("_digit")
    return _priorities(spark, sf_dir).select(
        F.col("o_orderpriority").alias("name"),
        F.concat(F.lit("ORDERS_"), digit).alias("table_name"),
        F.when(digit.isin("1", "3", "5"), "incremental").otherwise("full").alias("strategy"),
        F.when(digit == "1", "0 2 * * *")
        .when(digit == "2", "0 2 1 * *")
        .when(digit == "3", "0 */6 * * *")
        .when(digit == "4", "30 1 * * mon-fri")
        .otherwise("interval:15m")
        .alias("schedule"),
        (digit == "4").alias("paused"),
    )


def pause_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-time pause state: set for some pipelines, absent for the others."""
    digit = F.col("_digit")
    return (
        _priorities(spark, sf_dir)
        .where(digit.isin("2", "4"))
        .select(F.col("o_orderpriority").alias("name"), (digit == "2").alias("paused"))
    )


def dataset_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.col("_digit")
    return (
        _priorities(spark, sf_dir)
        .where(digit.isin("1", "3"))
        .select(F.col("o_orderpriority").alias("pipeline_name"), F.concat(F.lit("dataset_"), digit).alias("dataset_name"))
    )


def export_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export job record per order, as read from job files."""
    key = F.col("o_orderkey")
    created = F.col("o_orderdate") + F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)"))
    fmt = F.when(key % 3 == 0, "xlsx").when(key % 3 == 1, "csv.zip").otherwise("parquet")
    action = F.when(key % 3 == 0, "xlsx_export").when(key % 3 == 1, "csv_zip_export").otherwise("parquet_export")
    status = (
        F.when(key % 10 == 0, "queued")
        .when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "running")
        .otherwise("failed")
    )
    name = F.concat(F.lit("job-"), key.cast("string"))
    return table(spark, sf_dir, "orders").select(
        name.alias("job_id"),
        F.when(key % 2 == 0, "sales").otherwise("web").alias("dataset"),
        action.alias("action_key"),
        status.alias("status"),
        fmt.alias("format"),
        created.alias("created_at"),
        created.alias("updated_at"),
        (created + F.expr("INTERVAL 72 HOURS")).alias("expires_at"),
        F.concat_ws(".", name, fmt).alias("file_name"),
        F.concat(F.lit("artifacts/"), F.concat_ws(".", name, fmt)).alias("artifact_path"),
        F.when(status == "completed", F.col("o_custkey")).alias("row_count"),
        F.when(status == "failed", "export failed").alias("error_message"),
    )

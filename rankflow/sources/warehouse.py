"""The wide indicator table and its processing log, as versioned parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest_version(spark: SparkSession, path: str) -> int | None:
    """Greatest version that was written to its end (its folder holds `_SUCCESS`), empty ones included."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "version=*/_SUCCESS"))
    found = [m.getPath().getParent().getName().split("=", 1)[1] for m in marks or []]
    return max((int(v) for v in found if v.isdigit()), default=None)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """Newest version of a table, or None. No other version is listed or read."""
    newest = newest_version(spark, path)
    return None if newest is None else spark.read.parquet(f"{path}/version={newest}")


def write_table(df: DataFrame, path: str, replace: bool = True) -> int:
    """Store a new version. Readers of the old version, this job included, are not disturbed.

    What a failed attempt left behind under the same version is overwritten.
    """
    newest = newest_version(df.sparkSession, path)
    if newest is not None and not replace:
        raise ValueError(f"table exists: {path}")
    version = (newest or 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def split_incomplete(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows with and without a value in every required column."""
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    return df.where(complete), df.where(~complete)


def insert_counts(df: DataFrame, required: list[str]) -> DataFrame:
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("records_processed"),
        F.count_if(complete).alias("records_inserted"),
        F.count_if(~complete).alias("records_rejected"),
    )


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, the new one where a key is in both; several new rows: the greatest `_seq` wins.

    `new` may carry `_seq` (its order); the choice is an aggregate, so a hot key combines map-side.
    """
    columns = existing.columns
    rest = [c for c in columns if c != key]
    seq = F.col("_seq") if "_seq" in new.columns else F.lit(0)
    old_rows = existing.select(key, F.lit(0).alias("_new"), F.lit(0).cast("long").alias("_seq"), F.struct(*rest).alias("_r"))
    new_rows = new.select(key, F.lit(1).alias("_new"), seq.cast("long").alias("_seq"), F.struct(*rest).alias("_r"))
    kept = old_rows.unionByName(new_rows).groupBy(key).agg(F.max_by("_r", F.struct("_new", "_seq")).alias("_r"))
    return kept.select(key, "_r.*").select(*columns)


LOG_SCHEMA = (
    "process_type string, filename string, records_processed long, records_inserted long, records_rejected long,"
    " processing_time_seconds double, error_message string"
)


def log_row(spark: SparkSession, **values) -> DataFrame:
    names = [part.split()[0] for part in LOG_SCHEMA.split(",")]
    row = spark.createDataFrame([tuple(values.get(n) for n in names)], LOG_SCHEMA)
    return row.withColumn("created_at", F.current_timestamp())


def append_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def integrity(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, known rows, gaps, completeness in percent: one scan for all columns."""
    total = F.count(F.lit(1))
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            total.alias("total_records"),
            F.count(c).alias("non_null_records"),
            F.count_if(F.col(c).isNull()).alias("null_count"),
            F.round(F.try_divide(F.count(c) * 100.0, total), 2).alias("completeness_percentage"),
        ).alias(c)
        for c in columns
    ]
    return df.agg(*parts).select(F.explode(F.array(*[F.col(c) for c in columns])).alias("r")).select("r.*")


def integrity_status(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.max("total_records").alias("total_records"),
        F.sum("null_count").alias("total_nulls"),
        F.when(F.sum("null_count") == 0, "valid").otherwise("invalid").alias("integrity_status"),
    )


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("process_type").agg(
        F.count(F.lit(1)).alias("operation_count"),
        F.sum("records_processed").alias("total_processed"),
        F.sum("records_inserted").alias("total_inserted"),
        F.sum("records_rejected").alias("total_rejected"),
    )


def item_list(df: DataFrame, name: str = "country_name") -> DataFrame:
    return df.select(name).distinct().orderBy(name)


def export(df: DataFrame, columns: list[str], order: str, path: str | None = None) -> DataFrame:
    """The indicator columns in name order, optionally written as CSV with a header."""
    out = df.select(*columns).orderBy(order)
    if path:
        out.write.mode("errorifexists").csv(path, header=True)
    return out


def summary_text(checks: DataFrame, log: DataFrame) -> DataFrame:
    """Report lines (`section`, `line`) for completeness and processing history."""
    status = integrity_status(checks).select(
        F.lit("status").alias("section"),
        F.format_string(
            "%d records, %d missing values, %s", "total_records", "total_nulls", "integrity_status"
        ).alias("line"),
    )
    columns = checks.select(
        F.lit("completeness").alias("section"),
        F.format_string("%s: %.2f%% (%d/%d)", "column", "completeness_percentage", "non_null_records", "total_records").alias(
            "line"
        ),
    )
    history = log_summary(log).select(
        F.lit("history").alias("section"),
        F.format_string("%s: %d inserted, %d rejected", "process_type", "total_inserted", "total_rejected").alias("line"),
    )
    return status.unionByName(columns).unionByName(history)

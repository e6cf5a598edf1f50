"""Reports are tables; they are saved as JSON lines or as text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_report(section: str, df: DataFrame, key: str) -> DataFrame:
    """Any report table as `section`, `subject`, `metric`, `value` (text)."""
    metrics = [c for c in df.columns if c != key]
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in metrics]
    return df.select(
        F.lit(section).alias("section"), F.col(key).cast("string").alias("subject"), F.explode(F.array(*rows)).alias("r")
    ).select("section", "subject", "r.*")


def text_lines(report: DataFrame) -> DataFrame:
    return report.select(
        F.concat_ws(" | ", "section", "subject", F.concat_ws(": ", "metric", F.coalesce("value", F.lit("-")))).alias("line")
    )


def save_report(report: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "json":
        report.write.mode("errorifexists").json(path)
    elif kind == "text":
        text_lines(report).write.mode("errorifexists").text(path)
    else:
        raise ValueError(f"unsupported report format: {kind}")

"""Folders of indicator CSVs: one file per topic, each read on its own header."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.config import Settings
from rankflow.operators.profiling import duplicates, missing_profile, numeric_profile
from rankflow.operators.schema_rules import entity_column, indicator_type, numeric_columns

# Cell texts that mean "missing".
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """`path`, `length`, `modificationTime` (ms) of every CSV below the folder, empty files included.

    One row per topic file; Spark's own file sources would hide the empty ones.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        raise FileNotFoundError(f"input folder not found: {folder}")
    if not system.getFileStatus(root).isDirectory():
        raise ValueError(f"not a directory: {folder}")
    found, entries = [], system.listFiles(root, True)
    while entries.hasNext():
        e = entries.next()
        if e.getPath().getName().endswith(".csv"):
            found.append((e.getPath().toString(), e.getLen(), e.getModificationTime()))
    if not found:
        raise ValueError(f"no CSV files found in: {folder}")
    return spark.createDataFrame(sorted(found), "path string, length long, modificationTime long")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One file. A column is numeric if every cell that is not missing parses as a number.

    `_pos` is the row's place in the file: the start of its block, then its order in the block. A file
    with a line break inside quotes (a line with an odd number of quotes) is read as one block.
    """
    lines = spark.read.text(path)
    broken_lines = not lines.where("length(value) % 2 != length(replace(value, '\"', '')) % 2").isEmpty()
    raw = spark.read.csv(path, header=True, escape='"', multiLine=broken_lines, mode="PERMISSIVE")
    columns = raw.columns
    if not columns:
        raise ValueError(f"no columns to parse from file: {path}")
    cells = raw.select(
        *[F.when(~F.trim(F.col(f"`{c}`")).isin(MISSING_TEXT), F.col(f"`{c}`")).alias(c) for c in columns],
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("_pos"),
    )
    bad = [
        F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"b{i}")
        for i, c in enumerate(columns)
    ]
    broken = cells.agg(*bad).first()
    return cells.select(
        *[
            F.col(f"`{c}`").cast("double").alias(c) if broken[i] == 0 else F.col(f"`{c}`").alias(c)
            for i, c in enumerate(columns)
        ],
        "_pos",
    )


def entity_dictionary(tables: list[DataFrame], entity: str = "country") -> DataFrame:
    """`std_name`: distinct trimmed non-empty names of the entity column over all tables that have it."""
    names = [t.select(F.trim(F.col(f"`{entity}`").cast("string")).alias("std_name")) for t in tables if entity in t.columns]
    return reduce(DataFrame.unionByName, names).where("std_name <> ''").distinct()


@dataclass
class CsvFile:
    path: str
    bytes: int
    data: DataFrame | None = None
    error: str | None = None
    entity: str | None = None
    columns: list[str] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def stem(self) -> str:
        return self.name.rsplit(".", 1)[0]


def open_folder(spark: SparkSession, folder: str) -> list[CsvFile]:
    """Every file, opened or with its error. The file list is one entry per topic."""
    out = []
    for row in discover(spark, folder).collect():
        one = CsvFile(row["path"], row["length"])
        try:
            one.data = read_csv(spark, one.path)
            one.columns = [c for c in one.data.columns if c != "_pos"]
            one.entity = entity_column(one.columns)
        except Exception as error:  # one bad file becomes a row of the report
            one.error = f"{type(error).__name__}: {error}".splitlines()[0]
        out.append(one)
    return out


def _union(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, frames) if frames else None


@dataclass
class FolderReport:
    files: DataFrame
    missing: DataFrame | None
    numeric: DataFrame | None
    duplicates: DataFrame | None


FILE_SCHEMA = (
    "filename string, path string, file_size_mb double, row_count long, column_count int, columns array<string>,"
    " indicator_type string, entity_column string, duplicate_rows long, high_missing_columns array<string>,"
    " warnings int, status string, error string"
)


def validate_folder(spark: SparkSession, files: list[CsvFile], settings: Settings = Settings()) -> FolderReport:
    """Profiles of all files as four long tables; a file that cannot be read is a row with its error."""
    summary, missing, numeric, repeated = [], [], [], []
    for f in files:
        tag, size = F.lit(f.name).alias("filename"), f.bytes / (1024 * 1024)
        if f.error:
            row = [(f.name, f.path, size, 0, 0, [], None, None, 0, [], 0, "error", f.error)]
            summary.append(spark.createDataFrame(row, FILE_SCHEMA))
            continue
        data = f.data.drop("_pos")
        numbers = numeric_columns(data)
        text = F.lit(" ".join([*f.columns, f.stem]))
        high = F.array().cast("array<string>")
        if numbers:
            gaps = missing_profile(data, numbers, settings)
            missing.append(gaps.select(tag, "*"))
            numeric.append(numeric_profile(data, numbers).select(tag, "*"))
            high = F.array_compact(
                F.array(
                    *[
                        F.when(F.count_if(F.col(f"`{c}`").isNull()) > F.count(F.lit(1)) * settings.high_missing, F.lit(c))
                        for c in numbers
                    ]
                )
            )
        counts = data.agg(F.count(F.lit(1)).alias("row_count"), high.alias("high_missing_columns"))
        copies = F.lit(0).cast("long")
        if f.entity:
            again = duplicates(data, f"`{f.entity}`")
            repeated.append(again.select(tag, F.col("value").cast("string").alias("value"), "occurrences"))
            copies = again.agg(F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0))).scalar()
        one = counts.withColumns({"indicator_type": indicator_type(text), "duplicate_rows": copies})
        warned = (
            F.lit(int(f.entity is None))
            + F.col("indicator_type").isNull().cast("int")
            + (F.size("high_missing_columns") > 0).cast("int")
            + (F.col("duplicate_rows") > 0).cast("int")
        )
        summary.append(
            one.select(
                tag, F.lit(f.path).alias("path"), F.lit(size).alias("file_size_mb"), "row_count",
                F.lit(len(f.columns)).alias("column_count"), F.array(*[F.lit(c) for c in f.columns]).alias("columns"),
                "indicator_type", F.lit(f.entity).cast("string").alias("entity_column"), "duplicate_rows",
                "high_missing_columns", warned.alias("warnings"), F.lit("success").alias("status"),
                F.lit(None).cast("string").alias("error"),
            )
        )
    return FolderReport(_union(summary), _union(missing), _union(numeric), _union(repeated))

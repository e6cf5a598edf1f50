"""From a folder of indicator CSVs to one complete, scaled table."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.config import LOWER_IS_BETTER, WAREHOUSE_NAMES, Settings
from rankflow.functions import expr as X
from rankflow.functions.quantiles import quantiles
from rankflow.operators.impute import fill_every_gap, medians, require_complete
from rankflow.operators.match import match_report, resolve_names, resolve_rows
from rankflow.operators.merge import first_per_entity, merge_steps, number_entities, outer_merge
from rankflow.operators.scale import _unit, is_inverted, with_bounds, without_bounds
from rankflow.operators.schema_rules import numeric_columns, standard_names, to_warehouse_names
from rankflow.session import store
from rankflow.sources.csv_folder import CsvFile, FolderReport, entity_dictionary, open_folder, validate_folder
from rankflow.sources.reports import long_report
from rankflow.sources.warehouse import (
    append_log, insert_counts, integrity, log_row, split_incomplete, stamped, write_table,
)

DEFAULTS = Settings()


def clean_columns(
    df: DataFrame, columns: list[str], settings: Settings = DEFAULTS, lower_is_better=LOWER_IS_BETTER
) -> DataFrame:
    """Tiered imputation and scaling: up to 40 % missing gets the median, strictly below it is scaled,
    above it stays missing."""
    rates = df.agg(
        *[F.coalesce(F.try_divide(F.count_if(F.col(c).isNull()), F.count(F.lit(1))), F.lit(0.0)).alias(c) for c in columns]
    )
    known = X.attach(X.attach(df, rates, "_rate"), medians(df, columns), "_median")
    filled = known.withColumns(
        {
            c: F.when(F.col(f"_rate.{c}") <= settings.high_missing, F.coalesce(F.col(c), F.col(f"_median.{c}"))).otherwise(
                F.col(c)
            )
            for c in columns
        }
    ).drop("_median")
    bounds = quantiles(filled, columns, [settings.winsor_lower / 100, settings.winsor_upper / 100])
    flat, ends = with_bounds(filled, bounds, columns)
    scaled = {
        c: F.when(
            F.col(f"_rate.{c}") < settings.high_missing, _unit(F.col(c), *ends[c], is_inverted(c, lower_is_better))
        ).otherwise(F.col(c))
        for c in columns
    }
    return without_bounds(flat.withColumns(scaled), columns).drop("_rate")


def clean_table(
    rows: DataFrame, entity: str, order: list, columns: list[str], settings: Settings = DEFAULTS,
    lower_is_better=LOWER_IS_BETTER,
) -> DataFrame:
    """Resolved rows (`std_name`) -> one row per entity: matched, first wins, imputed, scaled.

    Columns with a dot or blank in the name are renamed before this step.
    """
    matched = rows.where("std_name IS NOT NULL").select(
        F.col("std_name").alias(entity), *columns, *[F.col(o).alias(o) if isinstance(o, str) else o for o in order]
    )
    once = first_per_entity(matched, entity, [F.col(o) for o in order]).select(entity, *columns)
    # Three statistics passes read the deduplicated rows, and merge, fill and reports the result.
    return store(clean_columns(store(once, "deduplicated"), columns, settings, lower_is_better), "cleaned")


@dataclass
class Ingest:
    table: DataFrame
    files: FolderReport
    cleaned: dict[str, DataFrame]
    matches: DataFrame
    steps: DataFrame
    seconds: float = 0.0


def clean_files(
    spark: SparkSession, files: list[CsvFile], settings: Settings = DEFAULTS, method: str = "token_set",
    dictionary: DataFrame | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Cleaned table per readable file with an entity column, and the match report over all of them."""
    usable = [f for f in files if f.error is None and f.entity]
    if not usable:
        raise ValueError("no CSV file could be cleaned")
    dictionary = dictionary if dictionary is not None else entity_dictionary([f.data for f in usable])
    names = None
    for f in usable:
        one = f.data.select(F.col(f"`{f.entity}`").cast("string").alias("name"), F.lit(f.name).alias("file"))
        names = one if names is None else names.unionByName(one)
    resolved = store(resolve_names(names, dictionary, method, settings.fuzzy_threshold), "resolved-names")
    cleaned = {}
    for f in usable:
        numbers = [c for c in numeric_columns(f.data) if c != f.entity]
        renames = standard_names(numbers, f.stem)
        plain = f.data.select(
            F.col(f"`{f.entity}`").cast("string").alias("_entity"), "_pos",
            *[F.col(f"`{c}`").alias(renames[c]) for c in numbers],
        )
        rows = resolve_rows(plain, "_entity", resolved)
        cleaned[f.name] = clean_table(rows, "country", ["_pos"], list(renames.values()), settings)
    return cleaned, match_report(resolve_rows(names, "name", resolved))


def ingest(
    spark: SparkSession, folder: str, settings: Settings = DEFAULTS, method: str = "token_set",
    out: str | None = None, log: str | None = None,
) -> Ingest:
    """Validate, clean, merge, fill and (with `out`) store: the whole cleaning job."""
    started = time.monotonic()
    files = open_folder(spark, folder)
    report = validate_folder(spark, files, settings)
    cleaned, matches = clean_files(spark, files, settings, method)
    merged = store(outer_merge(cleaned, "country"), "merged")
    values = [c for c in merged.columns if c != "country"]
    complete = to_warehouse_names(require_complete(store(fill_every_gap(merged, values), "filled"), values))
    table = number_entities(complete, "country_name")
    result = Ingest(table, report, cleaned, matches, merge_steps(cleaned, "country"))
    if out:
        required = [c for c in table.columns if c in WAREHOUSE_NAMES.values()]
        counts = insert_counts(table, required).first().asDict()
        accepted, _ = split_incomplete(table, required)
        write_table(stamped(accepted), out)
        result.seconds = time.monotonic() - started
        if log:
            append_log(
                log_row(
                    spark, process_type="single_table_insert", filename="merged_dataset",
                    processing_time_seconds=result.seconds, **counts,
                ),
                log,
            )
    return result


def ingest_report(result: Ingest) -> DataFrame:
    """Everything about one run as `section`, `subject`, `metric`, `value`."""
    features = [c for c in result.table.columns if c not in ("country_id", "country_name")]
    one = F.lit("all").alias("subject")
    return (
        long_report("files", result.files.files, "filename")
        .unionByName(long_report("matches", result.matches.select(one, "*"), "subject"))
        .unionByName(long_report("merge", result.steps, "name"))
        .unionByName(long_report("integrity", integrity(result.table, features), "column"))
    )

"""Data-quality reports on landed files, null counts and pipeline metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass import schemas as S
from stormglass.functions import values as V
from stormglass.operators.labels import is_crisis
from stormglass.sources.landing import Landed, read_landed

PASS_MB = 200.0


def file_report(
    spark: SparkSession,
    path: str,
    kind: str,
    required: tuple[str, ...],
    duplicate_keys: tuple[str, ...],
    counted: tuple[str, ...] | None = None,
    source: Column | None = None,
) -> DataFrame:
    """One row per source file: row count, missing columns, repeated keys, empty cells, dates, size.

    ``source`` maps the column ``file`` to a coarser name, such as the directory, if one source is
    spread over several files; a column that one of them lacks is missing then. Without ``counted`` the
    empty cells of all required columns that a file has are counted; with it only those, and only where
    the file has all of them. A file that cannot be read is a row with ``ok`` false and the ``error``.
    ``unreadable_dates`` counts rows whose date is missing, no date or out of the calendar: cleaning
    drops them.
    """
    landed: Landed = read_landed(spark, path)
    name = F.col("file") if source is None else source
    rows = landed.rows(required)

    def present(column):
        return F.get("_at", F.lit(required.index(column))) > 0

    if counted is None:
        empties = [present(c) & V.missing(F.col(f"`{c}`")) for c in required]
    else:
        whole = F.least(*[present(c).cast("int") for c in counted]) == 1
        empties = [whole & V.missing(F.col(f"`{c}`")) for c in counted]
    empty = sum((e.cast("long") for e in empties[1:]), empties[0].cast("long"))
    keyed = rows.select(
        name.alias("file"),
        F.struct(*duplicate_keys).alias("_key"),
        V.moment(F.col("Date")).alias("_time"),
        empty.alias("_empty"),
    )
    # Rows per key first: the sums afterwards never meet a hot file in one task.
    per_key = keyed.groupBy("file", "_key").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("_empty").alias("_empty"),
        F.count_if(F.col("_time").isNull()).alias("_lost"),
        F.min("_time").alias("_first"),
        F.max("_time").alias("_last"),
    )
    facts = per_key.groupBy("file").agg(
        F.sum("_rows").alias("_rows"),
        (F.sum("_rows") - F.count(F.lit(1))).alias("_duplicates"),
        F.sum("_empty").alias("_empty"),
        F.sum("_lost").alias("_lost"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
    )
    readable = F.col("error").isNull()
    absent = [
        F.when(F.count_if(readable & ~F.array_contains("header", c)) > 0, F.lit(c)) for c in sorted(required)
    ]
    sources = landed.files.groupBy(name.alias("file")).agg(
        F.array_compact(F.array(*absent)).alias("_missing"),
        F.min(readable & F.array_contains("header", "Date")).alias("_dated"),
        F.max("error").alias("error"),
        F.sum("file_size").alias("_bytes"),
    )
    span = F.concat_ws(
        " -> ",
        *[F.coalesce(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit("NaT")) for d in ("_first", "_last")],
    )
    zero = F.lit(0)
    return sources.join(facts, "file", "left").select(
        "file",
        F.lit(kind).alias("type"),
        (F.col("error").isNull() & (F.size("_missing") == 0)).alias("ok"),
        F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce("_rows", zero).alias("rows"),
        F.array_join("_missing", ",").alias("missing_required_cols"),
        F.when(F.col("_dated"), F.coalesce("_duplicates", zero)).otherwise(0).alias("duplicate_rows"),
        F.coalesce("_empty", zero).alias("na_cell_count"),
        F.when(F.col("_dated"), F.coalesce("_lost", zero)).otherwise(0).alias("unreadable_dates"),
        F.when(F.col("_dated"), span).otherwise("").alias("date_range"),
        F.bround(F.col("_bytes") / (1024 * 1024), 4).alias("size_mb"),
    )


def price_file_report(spark: SparkSession, path: str, source: Column | None = None) -> DataFrame:
    return file_report(spark, path, "price", S.RAW_PRICE_REQUIRED, ("Date",), source=source)


def macro_file_report(spark: SparkSession, path: str, source: Column | None = None) -> DataFrame:
    return file_report(
        spark, path, "macro", S.RAW_MACRO_REQUIRED, ("Date", "variable"), ("Date", "Value"), source
    )


def quality_totals(report: DataFrame, pass_mb: float = PASS_MB) -> DataFrame:
    """All files counted, the rest summed over sound files only, and the size gate."""
    ok = F.col("ok")
    totals = report.agg(
        F.count(F.lit(1)).alias("files"),
        *[
            F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c)
            for c in ("rows", "duplicate_rows", "na_cell_count", "unreadable_dates", "size_mb")
        ],
    )
    return totals.withColumn(
        "gate", F.when(F.col("size_mb") >= pass_mb, "PASS").otherwise("FAIL")
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Empty cells per column, one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], counts.columns, "column", "nulls")


def panel_metadata(labelled: DataFrame, dates: DataFrame) -> DataFrame:
    """Metric/value rows: assets, rows, crisis and normal days, empty cells."""
    empty = F.lit(0).cast("long")
    for c in labelled.columns:
        empty = empty + F.count_if(F.col(f"`{c}`").isNull())
    table = labelled.agg(
        F.count_distinct("asset").alias("total_assets_tracked"),
        F.count(F.lit(1)).alias("labeled_dataset_rows"),
        empty.alias("missing_cells_in_labeled"),
    )
    days = dates.agg(
        F.count_if(is_crisis()).alias("crisis_days"),
        F.count_if(F.col("final_crisis_label") == 0).alias("normal_days"),
    )
    parts = [
        part.select(*[F.col(c).cast("string") for c in part.columns]).unpivot(
            [], part.columns, "metric", "value"
        )
        for part in (table, days)
    ]
    return parts[0].unionByName(parts[1])


def pipeline_metadata(
    panel_facts: DataFrame, profile_facts: DataFrame, files: dict[str, int], outputs: int
) -> DataFrame:
    """Panel facts, storage profile, input file and output table counts as one metric/value table."""
    spark = panel_facts.sparkSession
    counts = [(name, str(n)) for name, n in files.items()]
    counts.append(("total_raw_files", str(sum(files.values()))))
    counts.append(("spark_output_files", str(outputs)))
    listed = spark.createDataFrame(counts, "metric string, value string")
    return listed.unionByName(panel_facts).unionByName(profile_facts)



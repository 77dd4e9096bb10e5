"""Scans of landed CSV files and the ingest log.

Files are matched by the names in their own headers, whatever the order, number or width of columns. The
text is read once: lines are written with the place they came from, and headers, rows and the state of every
file are taken from there. Records whose quoted cells hold line breaks are joined first (``records``). A file
that cannot be read as a table (empty, not UTF-8, with a row of more cells than its header, or with a quote
that is not closed) is left out whole and listed with the reason; an input error of the file system fails the job.

``_seq`` orders rows as they lie in the sorted files, so that "the last copy wins" means the same on
any cluster: file path, then split start, then place within the split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormglass import schemas as S
from stormglass.functions import values as V
from stormglass.functions.staging import MAX_BROADCAST_BYTES, staged
from stormglass.sources.records import cells_of, join_records, quote_states


def _row_order() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files with exactly this header; a file with another header fails the job, it is not misread."""
    return (
        _folder(spark)
        .schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .csv(path)
        .select("*", _row_order().alias("_seq"))
    )


def scan_prices(spark: SparkSession, path: str, by_name: bool = True) -> DataFrame:
    """Landed price files by name; without ``by_name`` by position, and any other header is an error."""
    if by_name:
        return normalize_price_columns(scan_by_name(spark, path, S.RAW_PRICE.names))
    return _strict(spark, path, S.RAW_PRICE)


def scan_macro(spark: SparkSession, path: str, by_name: bool = True) -> DataFrame:
    if by_name:
        return scan_by_name(spark, path, S.RAW_MACRO.names)
    return _strict(spark, path, S.RAW_MACRO)


def _folder(spark: SparkSession):
    return spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)


@dataclass(frozen=True)
class Landed:
    """Files of a folder and their rows.

    ``files``: file, file_size, header (null if the file is empty), error (null if it can be read).
    ``lines``: _seq and value of every record that is not blank, headers included.
    """

    files: DataFrame
    lines: DataFrame

    def rows(self, names: Sequence[str]) -> DataFrame:
        """Data rows of readable files: file, _seq, _at and the named columns.

        ``_at`` holds per name the column's place in the file, 0 for none. The layouts are broadcast if
        their size allows it; else the join goes by file and split, so one large file is not one key.
        """
        spark = self.lines.sparkSession
        places = F.array(*[F.coalesce(F.array_position("header", n), F.lit(0)).cast("int") for n in names])
        good = self.files.where("error IS NULL").select("file", "_head", places.alias("_at"))
        cells = cells_of(F.col("value")).alias("cells")
        lines = self.lines.select(F.col("_seq.file").alias("file"), F.col("_seq.block").alias("block"), "_seq", cells)
        if self.files.count() * (200 + 8 * len(names)) <= MAX_BROADCAST_BYTES:
            matched = lines.join(F.broadcast(good), "file")
        else:
            splits = lines.select("file", "block").distinct()
            matched = lines.join(good.join(splits, "file"), ["file", "block"])
        found = [F.get("cells", F.get("_at", F.lit(i)) - 1).alias(n) for i, n in enumerate(names)]
        data = matched.where((F.col("_seq.block") != 0) | (F.col("_seq.row") != F.col("_head")))
        return data.select("file", "_seq", "_at", *found)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_size) of every file. Spark's scans pass over files without bytes; the file index that
    the driver plans a scan with names them too."""

    def plain(name: Column) -> Column:
        return F.regexp_replace(name, r"^([a-z0-9]+):/+", "$1:/")

    scan = _folder(spark).format("binaryFile").load(path)
    filled = scan.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("file_size"))
    named = spark.createDataFrame([(name,) for name in scan.inputFiles()], "name string")
    both = named.join(filled, plain(F.col("name")) == plain(F.col("file")), "left")
    return both.select(F.coalesce("file", "name").alias("file"), F.coalesce("file_size", F.lit(0)).alias("file_size"))


def read_landed(spark: SparkSession, path: str) -> Landed:
    """One read of the text; what follows reads the written lines."""
    opens, stays = quote_states(F.col("value"))
    text = _folder(spark).text(path).select("value", _row_order().alias("_seq"))
    lines = staged(
        text.select(
            "_seq.file", "_seq.block", "_seq.row", "value", (~F.is_valid_utf8("value")).alias("odd"),
            F.size(cells_of(F.col("value"))).alias("width"), opens.alias("opens"), stays.alias("stays"),
        ),
        "landed-lines",
    )
    broken = lines.select("file", F.lit("").alias("reason")).limit(0)
    if not lines.where("opens").isEmpty():
        lines, broken = join_records(lines)
    lines = lines.where(F.trim("value") != "")
    first = lines.where("block = 0").groupBy("file").agg(F.min_by(F.struct("row", "value"), "row").alias("first"))
    header = F.transform(cells_of(F.col("first.value")), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    first = first.select("file", F.struct(F.col("first.row").alias("row"), header.alias("header")).alias("h"))
    widest = lines.groupBy("file").agg(F.max("width").alias("widest"), F.max("odd").alias("odd"))
    listed = _listed(spark, path)
    error = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("h").isNull(), "empty file")
        .when(F.col("odd"), "not UTF-8 text")
        .when(
            F.col("widest") > F.size("h.header"),
            F.concat(F.lit("a row has "), F.col("widest"), F.lit(" cells, the header "), F.size("h.header")),
        )
    )
    files = listed.join(first, "file", "left").join(widest, "file", "left").join(broken, "file", "left")
    files = files.select(
        "file", "file_size", F.col("h.header").alias("header"), F.col("h.row").alias("_head"), error.alias("error")
    )
    return Landed(staged(files, "files"), lines.select(F.struct("file", "block", "row").alias("_seq"), "value"))


def scan_by_name(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """CSV files whose headers differ in order, width or completeness; a missing column reads as null."""
    return read_landed(spark, path).rows(names).drop("file", "_at")


def normalize_price_columns(df: DataFrame) -> DataFrame:
    """Fixed price columns by name: trimmed names, two-level columns flattened, missing ones null."""
    found = {}
    for field in df.schema.fields:
        column = df[f"`{field.name}`"]
        if isinstance(field.dataType, T.StructType) and field.name != "_seq":
            column = column.getField(field.dataType.names[0])
        found.setdefault(field.name.strip(), column)
    missing = F.lit(None).cast("string")
    values = [found.get(n, missing).alias(n) for n in S.RAW_PRICE_REQUIRED[1:]]
    rest = [found[n].alias(n) for n in ("asset", "group", "source", "_seq") if n in found]
    return df.select(V.day(found.get("Date", missing)).alias("Date"), *values, *rest)


def normalize_macro_columns(
    df: DataFrame, variable: str, source: str, start: str, end: str
) -> DataFrame:
    """First two columns become date and value, ``.`` means missing, rows clip to a closed range."""
    first, second = (df[f"`{name}`"] for name in df.columns[:2])
    text = F.trim(second.cast("string"))
    return df.select(
        V.day(first).alias("Date"),
        V.number(F.nullif(text, F.lit("."))).alias("Value"),
        F.lit(variable).alias("variable"),
        F.lit(source).alias("source"),
    ).where(F.col("Date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def ingest_log(expected: DataFrame, landed: DataFrame, cached: DataFrame, key: str, path: str) -> DataFrame:
    """Status per expected source from the rows that landed now and those kept from before.

    ``expected`` has the key, its attributes and an ``optional`` flag.
    """
    new = landed.groupBy(key).agg(F.count(F.lit(1)).alias("_new"))
    old = cached.groupBy(key).agg(F.count(F.lit(1)).alias("_old"))
    fresh = F.coalesce("_new", F.lit(0))
    kept = F.coalesce("_old", F.lit(0))
    status = (
        F.when(fresh > 0, "SUCCESS")
        .when(kept > 0, "USING_CACHED: no rows landed")
        .when(F.col("optional"), "OPTIONAL_FAILED: no rows landed")
        .otherwise("FAILED: no rows landed")
    )
    rows = F.when(fresh > 0, fresh).otherwise(kept)
    attributes = [c for c in expected.columns if c not in (key, "optional")]
    return (
        expected.join(new, key, "left")
        .join(old, key, "left")
        .select(
            key,
            *attributes,
            status.alias("status"),
            rows.alias("rows"),
            F.when(rows > 0, F.concat(F.lit(f"{path}/"), F.col(key), F.lit(".csv")))
            .otherwise("")
            .alias("path"),
        )
    )


def last_copy(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the last row per key.

    Spark limits each key to one row before the shuffle, so a key with very many copies stays small.
    """
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_copy", F.row_number().over(w)).where("_copy = 1").drop("_copy")

"""CSV records that run over several lines, joined without reading a file in one task.

Whether a line begins inside a quoted cell depends on everything before it in its file. But each line is a
function from "inside at its start" to "inside at its end", and such functions compose associatively: the lines
of a split are composed into one function per split, the splits of a file in order give every split its state at
the start, and from there every line has its own. Only the few splits of a file are ordered in one window;
lines are ordered within their split.

A quote opens a cell only at the cell's start; inside, two quotes stand for one. What follows a closing quote up
to the comma belongs to the cell. Lines of one record are joined by a line feed. A file that ends inside
quotes, or has a record of more than ``MAX_RECORD_BYTES``, is broken and named with the reason: no group of
lines grows with the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.functions.staging import staged

MAX_RECORD_BYTES = 16 << 20

# Possessive loops: Java runs them without recursion, so long lines don't exhaust the stack.
_BODY = r'[^"]*+(?:""[^"]*+)*+'
_CLOSED = rf'"{_BODY}"[^,]*+'
_CELLS = rf'(?:(?:{_CLOSED}|[^",][^,]*+|),)*+'
CELL = rf'(?:^|,)({_CLOSED}|[^,]*+)'
#: A line that ends inside quotes, having begun outside or inside of them.
OPENS = rf'\A{_CELLS}"{_BODY}\z'
STAYS = rf'\A{_BODY}(?:"[^,]*+,{_CELLS}"{_BODY})?+\z'


def cells_of(record: Column) -> Column:
    """Cells of a CSV record, any number of them; an empty cell is null."""

    def plain(cell: Column) -> Column:
        body = F.regexp_replace(F.regexp_extract(cell, rf'^"({_BODY})"', 1), '""', '"')
        rest = F.regexp_extract(cell, rf'^"{_BODY}"([^,]*+)', 1)
        return F.nullif(F.when(cell.startswith('"'), F.concat(body, rest)).otherwise(cell), F.lit(""))

    return F.transform(F.regexp_extract_all(record, F.lit(CELL), F.lit(1)), plain)


def quote_states(line: Column) -> tuple[Column, Column]:
    """Whether the line ends inside quotes if it begins outside, and if it begins inside."""
    quoted = F.contains(line, F.lit('"'))
    return quoted & line.rlike(OPENS), ~quoted | line.rlike(STAYS)


def _odd(number: Column) -> Column:
    return F.pmod(number, F.lit(2))


def _walked(lines: DataFrame) -> DataFrame:
    """Per line the function of all lines of its split before it: (``base`` or the state at the start) + ``turns``.

    A line maps both states to one (constant), swaps them or leaves them; ``base`` stems from the last constant.
    """
    w = Window.partitionBy("file", "block").orderBy("row")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("opens") & ~F.col("stays")).cast("int")
    turned = lines.withColumn("swap", swap).withColumn("turns", F.sum("swap").over(upto))
    fixed = F.when(F.col("opens") == F.col("stays"), _odd(F.col("opens").cast("int") + F.col("turns")))
    turned = turned.withColumn("fixed", fixed)
    return turned.select(
        "file", "block", "row", "value", "odd", "width",
        F.last("fixed", True).over(upto).alias("base"), "turns",
        F.last("fixed", True).over(before).alias("base_before"), (F.col("turns") - F.col("swap")).alias("turns_before"),
    )


def _split_states(walked: DataFrame) -> DataFrame:
    """(file, block, start, end): the state in which each split begins and ends."""
    splits = walked.groupBy("file", "block").agg(F.max_by(F.struct("base", "turns"), "row").alias("last"))
    w = Window.partitionBy("file").orderBy("block")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    summed = splits.select("file", "block", "last", F.sum("last.turns").over(upto).alias("sum"))
    fixed = F.when(F.col("last.base").isNotNull(), _odd(F.col("last.base") + F.col("last.turns") + F.col("sum")))
    ends = summed.withColumn("fixed", fixed).select(
        "file", "block", _odd(F.coalesce(F.last("fixed", True).over(upto), F.lit(0)) + F.col("sum")).alias("end")
    )
    return ends.withColumn("start", F.coalesce(F.lag("end").over(w), F.lit(0)))


def _head_before(numbered: DataFrame) -> DataFrame:
    """Per split the record that its first lines go on with: (file, block, block and number of its head)."""
    heads = numbered.groupBy("file", "block").agg(F.max("no").alias("no"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("no") > 0, F.struct("block", "no")), True).over(w)
    return heads.select("file", "block", last.alias("head"))


def join_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of (file, block, row, value, odd, width, opens, stays), and the broken files (file, reason).

    A record has the place of its first line; files in which no quote stays open pass through as they are.
    """
    touched = lines.where("opens").select("file").distinct()
    columns = ["file", "block", "row", "value", "odd", "width"]
    whole = lines.join(touched, "file", "left_anti").select(*columns)
    walked = staged(_walked(lines.join(touched, "file", "left_semi")), "csv-walked")
    states = staged(_split_states(walked), "csv-splits")
    known = walked.join(states.select("file", "block", "start"), ["file", "block"])
    state = lambda base, turns: _odd(F.coalesce(base, "start") + F.col(turns))
    known = known.select(*columns, state("base_before", "turns_before").alias("before"), state("base", "turns").alias("after"))
    order = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    numbered = staged(known.withColumn("no", F.sum(1 - F.col("before")).over(order)), "csv-numbered")

    single = numbered.where("before = 0 AND after = 0").select(*columns)
    parts = numbered.where("before = 1 OR after = 1").join(_head_before(numbered), ["file", "block"])
    head = F.when(F.col("no") > 0, F.struct("block", "no")).otherwise(F.col("head"))
    parts = parts.withColumn("head", head)
    sizes = parts.groupBy("file", "head").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    long = sizes.where(F.col("bytes") > MAX_RECORD_BYTES).select(
        "file", F.lit(f"a record of more than {MAX_RECORD_BYTES} bytes").alias("reason")
    )
    last = states.groupBy("file").agg(F.max_by("end", "block").alias("end"))
    unclosed = last.where("end = 1").select("file", F.lit("a quote that is not closed").alias("reason"))
    broken = staged(unclosed.unionByName(long).groupBy("file").agg(F.min("reason").alias("reason")), "csv-broken")

    sound = parts.join(broken, "file", "left_anti").groupBy("file", "head")
    joined = sound.agg(F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("lines"), F.max("odd").alias("odd"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    first = F.get("lines", F.lit(0))
    records = joined.select("file", first["block"].alias("block"), first["row"].alias("row"), text.alias("value"), "odd")
    records = records.withColumn("width", F.size(cells_of(F.col("value"))))
    return staged(whole.unionByName(single).unionByName(records), "csv-records"), broken

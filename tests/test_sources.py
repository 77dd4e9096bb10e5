import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stormglass.config import MARKET
from stormglass.functions import values as V
from stormglass.functions.staging import (
    broadcast_days,
    broadcast_list,
    default_folder,
    release,
    shared_folder,
    staged,
    written_paths,
)
from stormglass.operators import clean as CL
from stormglass.operators import quality as Q
from stormglass.sources import dimensions as D
from stormglass.sources import landing as LD
from stormglass.sources import sinks as K
from stormglass.sources import tables as TB

HEADER = "Date,Open,High,Low,Close,Adj Close,Volume,asset,group,source"


def write(folder, name, *lines, bom=False):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8-sig" if bom else "utf-8") as out:
        out.write("\n".join(lines) + "\n")


def test_last_file_and_row_win(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER, "2020-01-01,1,1,1,1,1,5,X,g,s", "2020-01-01,2,2,2,2,2,5,X,g,s", bom=True)
    write(tmp_path, "b.csv", HEADER, "2020-01-02,3,3,3,3,3,,X,g,s", "bad,9,9,9,9,9,9,X,g,s")
    write(tmp_path, "c.csv", HEADER, "2020-01-02,4,4,4,x,,7,X,g,s", "2020-01-03,,,,,,,X,g,s")
    for by_name in (False, True):
        rows = CL.clean_prices(LD.scan_prices(spark, str(tmp_path), by_name=by_name)).orderBy("date").collect()
        assert [(r["date"], r["open"], r["close"], r["adj_close"], r["volume"]) for r in rows] == [
            (date(2020, 1, 1), 2.0, 2.0, 2.0, 5.0),
            (date(2020, 1, 2), 4.0, 2.0, 2.0, 7.0),
            (date(2020, 1, 3), 4.0, 2.0, 2.0, 0.0),
        ]


def test_other_header_fails_by_position_and_reads_by_name(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER, "2020-01-01,1,1,1,1,1,5,X,g,s")
    write(tmp_path, "b.csv", " asset ,Date,Close", "Y,2020-01-01,8")
    with pytest.raises(Exception, match="CSV header"):
        LD.scan_prices(spark, str(tmp_path), by_name=False).collect()
    found = LD.scan_prices(spark, str(tmp_path), by_name=True)
    rows = {r["asset"]: (r["Date"], r["Close"], r["Open"]) for r in found.collect()}
    assert rows == {"X": (date(2020, 1, 1), "1", "1"), "Y": (date(2020, 1, 1), "8", None)}


def test_quality_report(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER, "2020-01-02,1,,1,1,1,5,X,g,s", "2020-01-01,1,1,1,1,1,5,X,g,s",
          "2020-01-01,1,1,1,1,,5,X,g,s", "2020-01-01,1,1,1,1,,5,X,g,s")
    write(tmp_path, "b.csv", "Date,Open,Close", "2020-01-05,,1", "Date,Open,Close")
    write(tmp_path, "c.csv", HEADER)
    report = Q.price_file_report(spark, str(tmp_path), F.regexp_extract("file", "([a-z]).csv$", 1))
    rows = {r["file"]: r for r in report.collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert (a["ok"], a["rows"], a["duplicate_rows"], a["na_cell_count"]) == (True, 4, 2, 3)
    assert a["date_range"] == "2020-01-01 00:00:00 -> 2020-01-02 00:00:00"
    assert (b["ok"], b["rows"], b["missing_required_cols"]) == (False, 2, "Adj Close,High,Low,Volume")
    assert b["na_cell_count"] == 1
    assert (c["rows"], c["duplicate_rows"], c["na_cell_count"]) == (0, 0, 0)
    totals = Q.quality_totals(report).first()
    assert (totals["files"], totals["rows"], totals["duplicate_rows"]) == (3, 4, 2)
    assert totals["gate"] == "FAIL"
    assert Q.quality_totals(report, pass_mb=0.0).first()["gate"] == "PASS"


def test_files_that_are_no_tables(spark, tmp_path):
    wide = ",".join(["Date", "Close", *[f"x{i}" for i in range(60)]])
    write(tmp_path, "a.csv", wide, "2020-01-01 09:30:00,3" + ",0" * 60, "2020-01-02,NA" + "," * 60)
    write(tmp_path, "b.csv", "Date,Open,High,Low,Close,Adj Close", "2020-01-01,1,1,1,1,1", "1500-01-01,1,1,1,1,1", "none,null,1,1,1,1")
    write(tmp_path, "c.csv", "Date,Open,High,Low,Close,Volume", '2020-01-01,"1",1,1,1,"5,5"')
    write(tmp_path, "d.csv", "Date,Close", "2020-01-01,1,2")
    open(tmp_path / "e.csv", "w").close()
    with open(tmp_path / "f.csv", "wb") as out:
        out.write(b"Date,Close\n2020-01-01,\xff\xfe\n")
    with open(tmp_path / "g.csv", "w") as out:
        out.write("\n\n  \n")
    names = F.regexp_extract("file", "([a-z]).csv$", 1)
    rows = {r["file"]: r for r in Q.price_file_report(spark, str(tmp_path), names).collect()}
    assert set(rows) == set("abcdefg")
    assert [rows[f]["error"] for f in "abc"] == [""] * 3
    assert rows["d"]["error"] == "a row has 3 cells, the header 2" and rows["f"]["error"] == "not UTF-8 text"
    assert rows["e"]["error"] == rows["g"]["error"] == "empty file"
    assert all(not rows[f]["ok"] and rows[f]["rows"] == 0 for f in "defg")
    assert rows["a"]["date_range"] == "2020-01-01 09:30:00 -> 2020-01-02 00:00:00" and rows["a"]["na_cell_count"] == 1
    assert (rows["b"]["rows"], rows["b"]["unreadable_dates"], rows["b"]["na_cell_count"]) == (3, 2, 1)
    both = Q.price_file_report(spark, str(tmp_path), F.when(names.isin("b", "c"), "bc").otherwise(names))
    assert both.where("file = 'bc'").first()["missing_required_cols"] == "Adj Close,Volume"
    scanned = LD.scan_prices(spark, str(tmp_path)).collect()
    assert len(scanned) == 6
    assert {r["Volume"] for r in scanned} == {None, "5,5"}
    assert Q.quality_totals(both).first()["files"] == 6


def read_by_python(path):
    import csv

    with open(path, newline="") as file:
        rows = [r for r in csv.reader(file) if r]
    return [dict(zip(rows[0], r)) for r in rows[1:]]


def test_quoted_line_breaks_over_splits(spark, tmp_path):
    draw = random.Random(11)
    parts = ['""', "\n", "\n\n", ",", "a", "é b", " ", "x,y\n", '"",""']
    for name in "abc":
        lines = ["Date,Open,source"]
        for day in range(3000):
            note = "".join(draw.choices(parts, k=draw.randint(0, 12)))
            cell = f'"{note}"' if draw.random() < 0.7 else draw.choice(["plain", "in\"side", "", '"q"tail'])
            lines.append(f"{date(2001, 1, 1) + timedelta(day)},{day},{cell}")
            if draw.random() < 0.05:
                lines.append("")
        write(tmp_path, f"{name}.csv", *lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = LD.scan_prices(spark, str(tmp_path)).select("_seq.file", "_seq.block", "Date", "Open", "source").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({(r["file"], r["block"]) for r in found}) > 50
    for name in "abc":
        got = sorted((int(r["Open"]), r["Date"].isoformat(), r["source"] or "") for r in found if r["file"].endswith(f"{name}.csv"))
        want = [(int(r["Open"]), r["Date"], r["source"]) for r in read_by_python(tmp_path / f"{name}.csv")]
        assert got == want


def test_record_over_many_splits(spark, tmp_path):
    note = "\n".join(f"line {i}, with ""quotes""" for i in range(3000))
    write(tmp_path, "a.csv", "Date,Close,source", f'2020-01-01,1,"{note}"', "2020-01-02,2,s")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = {r["Close"]: r["source"] for r in LD.scan_prices(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {"1": note, "2": "s"}


def test_broken_quotes_are_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("stormglass.sources.records.MAX_RECORD_BYTES", 100)
    write(tmp_path, "a.csv", "Date,Close,source", '2020-01-01,1,"no end', "2020-01-02,2,s")
    write(tmp_path, "b.csv", "Date,Close,source", '2020-01-01,1,"' + "\n".join("long" * 3 for _ in range(20)) + '"')
    write(tmp_path, "c.csv", '"Da', 'te",Close,Date', '"x', '",1,2020-01-01')
    write(tmp_path, "d.csv", "Date,Close", '2020-01-01,5" pipe', "2020-01-02," + '"' + 'q""' * 3000 + '"')
    names = F.regexp_extract("file", "([a-z]).csv$", 1)
    rows = {r["file"]: (r["error"], r["rows"]) for r in Q.price_file_report(spark, str(tmp_path), names).collect()}
    assert rows["a"] == ("a quote that is not closed", 0) and rows["b"] == ("a record of more than 100 bytes", 0)
    assert rows["c"] == ("", 1) and rows["d"] == ("", 2)
    assert {r["Close"] for r in LD.scan_prices(spark, str(tmp_path)).collect()} == {"1", '5" pipe', 'q"' * 3000}


def test_layouts_beyond_the_broadcast_limit(spark, tmp_path, monkeypatch):
    write(tmp_path, "a.csv", HEADER, "2020-01-01,1,1,1,1,1,5,X,g,s")
    write(tmp_path, "b.csv", "asset,Date,Close", "Y,2020-01-01,8")
    monkeypatch.setattr(LD, "MAX_BROADCAST_BYTES", 0)
    rows = LD.scan_prices(spark, str(tmp_path))
    assert {(r["asset"], r["Close"]) for r in rows.collect()} == {("X", "1"), ("Y", "8")}


def test_macro_dot_is_missing_and_carried(spark, tmp_path):
    write(tmp_path, "m.csv", "Date,Value,variable,source", "2020-01-01,1.5,A,f", "2020-01-02,.,A,f",
          "2020-01-01,7,B,f", "2020-01-03,.,C,f")
    clean = CL.clean_macro(LD.scan_macro(spark, str(tmp_path)))
    assert {(r["variable"], r["date"].day): r["value"] for r in clean.collect()} == {
        ("A", 1): 1.5, ("A", 2): 1.5, ("B", 1): 7.0, ("C", 3): None,
    }
    wide = CL.macro_wide(clean, ("A", "B", "C"))
    assert {r["date"].day: (r["A"], r["B"], r["C"]) for r in wide.collect()} == {
        1: (1.5, 7.0, None), 2: (1.5, None, None),
    }


def test_normalize_columns(spark):
    df = spark.sql("SELECT '2020-01-01' AS Date, named_struct('SPY', 3.0) AS ` Close `, 'X' AS asset")
    row = LD.normalize_price_columns(df).first()
    assert (row["Date"], row["Close"], row["Volume"], row["asset"]) == (date(2020, 1, 1), 3.0, None, "X")
    macro = spark.createDataFrame(
        [("2020-01-01", "."), ("2020-01-02", "2.5"), ("2021-01-01", "3"), ("no", "1")], "DATE string, V string"
    )
    rows = LD.normalize_macro_columns(macro, "V", "f", "2020-01-01", "2020-12-31").collect()
    assert [(r["Value"], r["variable"]) for r in rows] == [(None, "V"), (2.5, "V")]


def test_values(spark):
    row = spark.range(1).select(
        V.number(F.lit("nan")).alias("nan"),
        V.number(F.lit("x")).alias("text"),
        V.finite(F.lit(float("-inf"))).alias("inf"),
        V.ratio(F.lit(1.0), F.lit(0.0)).alias("zero"),
        V.day(F.lit("1500-01-01")).alias("early"),
        V.day(F.lit("2020-02-30")).alias("wrong"),
        V.percent(F.lit(1), F.lit(16)).alias("even"),
        V.percent(F.lit(1), F.lit(0)).alias("none"),
        V.percent_text(F.lit(0.0123456), 2, signed=True).alias("text_signed"),
    ).first()
    assert [row[c] for c in ("nan", "text", "inf", "zero", "early", "wrong")] == [None] * 6
    assert (row["even"], row["none"], row["text_signed"]) == (6.2, 0.0, "+1.23%")


def test_first_group_wins(spark):
    from dataclasses import replace

    profile = replace(MARKET, groups=(("a", ("X", "Y")), ("b", ("Y", "Z"))))
    assert {(r["asset"], r["group"]) for r in D.asset_groups(spark, profile).collect()} == {
        ("X", "a"), ("Y", "a"), ("Z", "b"),
    }
    assert D.asset_groups(spark, MARKET).count() == 35


def test_partitions_read_back_and_prune(spark, tmp_path):
    df = spark.createDataFrame(
        [(date(2020, 1, 1), "GC=F", "gold", 1.0), (date(2021, 1, 1), "SPY", "stock", 2.0)],
        "date date, asset string, group string, close double",
    )
    path = str(tmp_path / "prices")
    K.write_partitioned(TB.with_calendar(df), path)
    back = spark.read.parquet(path).where("asset = 'GC=F'")
    assert [(r["asset"], r["year"]) for r in back.collect()] == [("GC=F", 2020)]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(asset" in plan


def test_load_table_prefers_parquet(spark, tmp_path):
    df = spark.createDataFrame([(date(2020, 1, 1), 1.5)], "date date, v double")
    base = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        TB.load_table(spark, base, df.schema)
    K.write_csv(df.withColumn("v", F.lit(2.5)), f"{base}.csv")
    assert TB.load_table(spark, base, df.schema).first()["v"] == 2.5
    K.write_parquet(df, f"{base}.parquet")
    assert TB.load_table(spark, base, df.schema).first()["v"] == 1.5


def test_no_driver_disk_on_a_cluster(spark):
    for master in ("local[4]", "local", "local[*]"):
        assert default_folder(spark, "file:/tmp/w", master).startswith("file:/tmp/w/")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            default_folder(spark, "file:/tmp/w", master)


def test_released_tables_are_gone(spark):
    before = written_paths(spark)
    df = staged(spark.range(5), "gone")
    mine = [p for p in written_paths(spark) if p not in before]
    assert len(mine) == 1 and df.count() == 5
    release(spark, mine)
    assert written_paths(spark) == before
    with pytest.raises(Exception):
        spark.read.parquet(mine[0])


def test_staging(spark):
    assert shared_folder(spark)
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    back = staged(df, "t")
    assert back.schema.names == df.schema.names and back.agg(F.sum("x")).first()[0] == 90
    assert "ResolvedHint" in broadcast_days(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_list(df, 10**9)._jdf.queryExecution().analyzed().toString()


def test_analysis_columns_of_the_market():
    assert len(K.analysis_columns(MARKET)) == 36
    assert sum(vars(MARKET.weights).values()) == pytest.approx(1.0)


def test_ingest_log(spark):
    known = spark.createDataFrame([("A", False), ("B", False), ("C", True), ("D", False)], "asset string, optional boolean")
    new = spark.createDataFrame([("A",), ("A",)], "asset string")
    old = spark.createDataFrame([("A",), ("B",)], "asset string")
    log = {r["asset"]: (r["status"].split(":")[0], r["rows"], r["path"]) for r in LD.ingest_log(known, new, old, "asset", "p").collect()}
    assert log == {
        "A": ("SUCCESS", 2, "p/A.csv"), "B": ("USING_CACHED", 1, "p/B.csv"),
        "C": ("OPTIONAL_FAILED", 0, ""), "D": ("FAILED", 0, ""),
    }

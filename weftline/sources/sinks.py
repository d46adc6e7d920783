"""Writes that check first, swap whole, or go on where they stopped; and small reports and settings."""

from __future__ import annotations

import csv
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.texts import cell


def checked_overwrite(rows: DataFrame, violations: DataFrame, path: str) -> None:
    """Write rows only if violations (check_name, violations) finds nothing; what was there stays otherwise."""
    if broken := [tuple(r) for r in violations.filter("violations > 0").limit(50).collect()]:
        raise ValueError(f"not written: {broken}")
    rows.write.mode("overwrite").parquet(path)


def _paths(spark: SparkSession, *names: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    found = [hadoop(n) for n in names]
    return found[0].getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def swap_in(rows: DataFrame, path: str) -> None:
    """Write beside path, then take its place by two renames. Between them path is missing for a moment; the old table is then at
    path.old, and stays there if the second rename fails."""
    rows.write.mode("overwrite").parquet(f"{path}.new")
    fs, (old, new, last) = _paths(rows.sparkSession, path, f"{path}.new", f"{path}.old")
    fs.delete(last, True)
    if fs.exists(old):
        fs.rename(old, last)
    fs.rename(new, old)
    fs.delete(last, True)


#: The file that names the current version of a published table, and how many versions stay beside it.
POINTER, VERSIONS = "CURRENT", 2


def publish(rows: DataFrame, path: str, keep: int = VERSIONS) -> str:
    """Write rows as a new version under path and let the pointer name it; give the version's path.

    The pointer is one small file that is written beside and renamed over the old one, which is one step: a reader that resolves it sees the old
    version or the new, never none. A write that fails leaves the pointer as it was. All but the `keep` newest versions are removed, so a reader has
    a run's time to finish.
    """
    spark = rows.sparkSession
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{path}/{version}")
    point(spark, path, version)
    fs, (root,) = _paths(spark, path)
    held = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("v-"))
    for old in held[:-keep] if keep else []:
        if old != version:
            fs.delete(_paths(spark, f"{path}/{old}")[1][0], True)
    return f"{path}/{version}"


def point(spark: SparkSession, path: str, version: str) -> None:
    """Let the pointer of a published table name a version that is there."""
    hadoop, (target, made) = spark._jvm.org.apache.hadoop.fs, _paths(spark, f"{path}/{POINTER}", f"{path}/{POINTER}.{uuid.uuid4().hex}")[1]
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(made, True)
    out.write(bytearray(version.encode()))
    out.close()
    kind = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(made, target, how)


def published(spark: SparkSession, path: str) -> str:
    """The path of a published table's current version."""
    lines = spark.read.text(f"{path}/{POINTER}").collect()  # one line
    if len(lines) != 1:
        raise ValueError(f"{path} has no pointer of one line")
    return f"{path}/{lines[0]['value']}"


def pipe_table(rows: DataFrame, most: int = 1000) -> list[str]:
    """rows as the lines of a pipe table, in their order; a report shows some dozens, and over `most` are refused."""
    shown = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(cell(F.col(f"`{c}`").cast("string")), F.lit("")) for c in rows.columns]), F.lit(" |")).alias("line")).limit(most + 1).collect()
    if len(shown) > most:
        raise ValueError(f"a table of over {most} rows is no report")
    head = [f"| {' | '.join(rows.columns)} |", f"| {' | '.join(['---'] * len(rows.columns))} |"]
    return [*head, *(r["line"] for r in shown)] if shown else ["None."]


def write_report(title: str, sections: Mapping[str, DataFrame], rows: DataFrame, path: str) -> None:
    """rows as JSON lines under path/rows, and path/report.md with a pipe table for each section, on any file system."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").json(f"{path}/rows")
    text = [f"# {title}", ""]
    for name, table in sections.items():
        text += [f"## {name}", "", *pipe_table(table), ""]
    fs, (target,) = _paths(spark, f"{path}/report.md")
    out = fs.create(target, True)
    out.write(bytearray("\n".join(text).encode()))
    out.close()


def append_log(rows: DataFrame, path: str, at: str) -> None:
    """Append to a log that is kept by day."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def compute_missing(keys: DataFrame, done: DataFrame, key: str, compute: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """compute over each different key that done lacks; join the result, with done, back to the rows by key."""
    return keys.select(key).filter(F.col(key).isNotNull()).distinct().join(done.select(key), key, "left_anti").mapInPandas(compute, schema)


def rewrite_settings(path: str, changes: Mapping[str, float], check: Callable[[dict[str, float]], None] = lambda values: None) -> None:
    """New values in a name,value,... file: rows, their order and other columns stay; an unknown name or a failed check changes nothing."""
    with open(path, encoding="utf-8", newline="") as file:
        reader = csv.DictReader(file)
        columns, rows = reader.fieldnames or [], list(reader)
    if unknown := set(changes) - {r["name"] for r in rows}:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    for r in rows:
        if r["name"] in changes:
            r["value"] = f"{changes[r['name']]:g}"
    check({r["name"]: float(r["value"]) for r in rows})
    new = Path(f"{path}.new")
    with new.open("w", encoding="utf-8", newline="") as file:
        writer = csv.DictWriter(file, columns, lineterminator="\n")
        writer.writeheader()
        writer.writerows(rows)
    new.replace(path)


def report_tables(spark: SparkSession, path: str) -> DataFrame:
    """(table, row, cells) of a report's pipe tables, numbered from 0, without header rules. A report is one file, read as one row.

    Lines that start with a pipe and follow each other are a table; cells are trimmed.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    marked = lines.withColumn("is_row", F.ltrim("line").startswith("|"))
    in_order = Window.orderBy("at")
    begins = F.col("is_row") & ~F.coalesce(F.lag("is_row").over(in_order), F.lit(False))
    numbered = marked.withColumn("table", F.sum(begins.cast("int")).over(in_order) - 1).filter("is_row")
    inner = F.regexp_replace(F.trim("line"), r"^\|+|\|+$", "")
    cells = numbered.select("table", "at", F.transform(F.split(inner, r"\|"), F.trim).alias("cells")).filter(~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))
    row = F.row_number().over(Window.partitionBy("table").orderBy("at")) - 1
    return cells.select(F.col("table").cast("int").alias("table"), row.cast("int").alias("row"), "cells")


def number_of(cell):
    """The number that a report's cell begins with: "40.0% [..]" is 0.4; null for none."""
    first = F.regexp_extract(F.replace(cell, F.lit(","), F.lit("")), r"^\s*(-?[0-9]+(?:\.[0-9]+)?)", 1)
    share = cell.rlike(r"^\s*-?[0-9.,]+\s*%")
    return F.when(share, F.nullif(first, F.lit("")).cast("double") / 100).otherwise(F.nullif(first, F.lit("")).cast("double"))


def today_weather(answers: DataFrame, column: str = "json", rain_from: float = 50.0) -> DataFrame:
    """Today's record of a forecast: mean felt temperature, its season, chance of rain and a word for the sky."""
    shape = "daily struct<apparent_temperature_max:array<double>,apparent_temperature_min:array<double>,precipitation_probability_max:array<double>,weather_code:array<int>>"
    d = answers.select(F.from_json(column, shape).alias("a")).select("a.daily.*")
    at = lambda c: F.get(F.col(c), F.lit(0))
    felt = (at("apparent_temperature_max") + at("apparent_temperature_min")) / 2
    code = at("weather_code")
    sky = F.when(code == 0, "clear").when(code <= 3, "cloudy").when(code.isin(45, 48), "fog").when(code.isin(71, 73, 75, 77, 85, 86), "snow").when(code >= 95, "storm").when(code >= 51, "rain")
    return d.select(
        F.bround(felt, 1).alias("feels_like"), F.when(felt >= 24, "summer").when(felt < 14, "winter").when(felt.isNotNull(), "mid-season").alias("season"),
        at("precipitation_probability_max").alias("rain_chance"), (at("precipitation_probability_max") >= rain_from).alias("rain_likely"), sky.alias("sky"),
    )

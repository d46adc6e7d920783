"""Catalogue files: all-text CSV, ragged CSV, image annotations, file trees and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV whose columns are all text: "NA" stays text and an empty field stays empty, so nothing is guessed."""
    shape = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(shape).csv(path, header=True, nullValue="\u0000", emptyValue="", multiLine=True, escape='"').na.fill("")


def read_ragged_csv(spark: SparkSession, path: str, columns: list[str], integers: list[str] = ()) -> DataFrame:
    """Lines without quoting whose last field may hold commas: extra fields are put back together there.

    "" and "NA" become null, integers that aren't one become null, and repaired tells lines that had extra fields.
    """
    n = len(columns)
    header = ",".join(columns)
    parts = F.split("value", ",", -1)
    fields = [F.get(parts, i) for i in range(n - 1)] + [F.array_join(F.slice(parts, n, F.greatest(F.size(parts), F.lit(n))), ",")]
    known = lambda c: F.when(~c.isin("", "NA"), c)
    out = spark.read.text(path).filter((F.col("value") != header) & (F.trim("value") != ""))
    cast = lambda name, c: c.try_cast("int") if name in integers else c
    return out.select(*[cast(name, known(F.trim(f))).alias(name) for name, f in zip(columns, fields, strict=True)], (F.size(parts) > n).alias("repaired"))


def read_annotations(spark: SparkSession, path: str, split: str, kept_masks: float = 1.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of a COCO-style file, with ids that carry the split; masks of a seeded share only are kept."""
    shape = (
        "images array<struct<id:long,width:int,height:int,file_name:string>>, "
        "annotations array<struct<id:long,image_id:long,category_id:int,attribute_ids:array<int>,bbox:array<double>,segmentation:string>>"
    )
    whole = spark.read.schema(shape).json(path, multiLine=True)
    named = lambda c: F.concat_ws("_", F.lit(split), F.col(c).cast("string")).alias(c)
    images = whole.select(F.inline("images")).select(named("id"), "width", "height", "file_name")
    flat = whole.select(F.inline("annotations"))
    box = [F.get("bbox", i).alias(n) for i, n in enumerate("xywh")]
    chosen = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < kept_masks * 1_000_000
    return images, flat.select(named("id"), named("image_id"), "category_id", "attribute_ids", *box, F.when(chosen, F.col("segmentation")).alias("segmentation"))


def scan_pictures(spark: SparkSession, path: str, pattern: str = r"([^/_]+)_([0-9]+)\.jpe?g$") -> DataFrame:
    """Files of a tree with the set and place that their names tell, size and MD5; other names have a null set, empty files no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = lambda i: F.nullif(F.regexp_extract("path", pattern, i), F.lit(""))
    return files.select("path", part(1).alias("set_id"), part(2).cast("int").alias("place"), "length", F.md5("content").alias("md5"))


def read_settings(spark: SparkSession, path: str, names: list[str]) -> dict[str, float]:
    """A name,value file as numbers: a missing or unknown name stops the run. Such files have some dozens of rows."""
    found = spark.read.csv(path, header=True).select("name", "value").limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError(f"{path} has over 10,000 rows: no settings file")
    rows = {r["name"]: float(r["value"]) for r in found}
    if missing := sorted(set(names) - set(rows)):
        raise ValueError(f"{path}: missing rows {missing}")
    if unknown := sorted(set(rows) - set(names)):
        raise ValueError(f"{path}: unknown rows {unknown}")
    return rows


def widest_vector(df: DataFrame, prefix: str = "e") -> DataFrame:
    """Columns e0, e1, ... as one array in order of their numbers; null where one isn't a number."""
    own = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    vector = F.array(*[F.col(c).try_cast("float") for c in own])
    return df.withColumn("embedding", F.when(F.forall(vector, lambda x: x.isNotNull()), vector)).drop(*own)


def read_cases(spark: SparkSession, path: str, schema: str, split: str = "all") -> DataFrame:
    """Labelled cases, one JSON document a line, of one split (a case without one is "dev") or of all; two cases of one id stop the run."""
    cases = spark.read.schema(schema).json(path, mode="FAILFAST").withColumn("split", F.coalesce("split", F.lit("dev")))
    if twice := [r["id"] for r in cases.groupBy("id").count().filter("count > 1 or id is null").orderBy("id").limit(20).collect()]:
        raise ValueError(f"{path}: cases of one id, or of none: {twice}")
    return cases if split == "all" else cases.filter(F.col("split") == split)

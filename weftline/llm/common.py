"""What the corpus operators share: scratch tables, text columns and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a table that settle() wrote once no later plan reads it."""
    path = getattr(df, "_settled_at", None)
    if path:
        files, where = _file_system(df.sparkSession, path)
        files.delete(where, True)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def word_pieces(spaced: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text that has blanks only between them, in turn, about size bytes at a time."""
    at = 0
    while at < len(spaced):
        stop = spaced.find(b" ", at + size)
        stop = len(spaced) if stop < 0 else stop
        yield spaced[at:stop].split()
        at = stop


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable:
    """A mapInArrow function: make() runs once a task and gives what turns one batch into another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = make()
        for batch in batches:
            if batch.num_rows:
                yield turn(batch)

    return run

"""Importance resampling towards a target distribution, over hashed word n-grams held as tuples of word numbers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, settle, text_of, word_pieces

BUCKETS, ORDERS = 10_000, 2
#: Bytes of text that share one dictionary; a longer text has one of its own.
BLOCK_BYTES = 8_000_000
NEW = ("n_words", "n_features", "weight", "score", "rank")
#: A-Z are lower-cased; all ASCII but digits and letters parts words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


class Block:
    """The n-grams of some texts: words are numbered in a dictionary, an n-gram is the pair (number of its first n - 1 words, number
    of its last word), and each distinct one has its bucket worked out once."""

    def __init__(self, texts: list[bytes], orders: int, buckets: int):
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        told = [np.fromiter(chain.from_iterable(map(numbers.__getitem__, words) for words in word_pieces(text.translate(_FOLD))), np.int64) for text in texts]
        self.lengths = np.array([len(t) for t in told], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        self.buckets = buckets
        #: By order: each n-gram's text, its distinct tuple's index, how often that occurs, and its bucket.
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        words = np.concatenate([np.zeros(0, np.int64), *told])
        spaced = [b" " + w for w in numbers]
        index, hashes, at = words, list(map(crc32, numbers)), np.arange(len(words))
        self._add(at, index, np.bincount(words, minlength=len(numbers)), hashes)
        for order in range(2, orders + 1):
            fits = at + order - 1 < len(words)
            fits[fits] = self.doc[at[fits]] == self.doc[at[fits] + order - 1]
            at, index = at[fits], index[fits]
            tuples, index, counts = np.unique(index * len(numbers) + words[at + order - 1], return_inverse=True, return_counts=True)
            head, last = np.divmod(tuples, max(len(numbers), 1))
            hashes = [crc32(spaced[w], hashes[h]) for h, w in zip(head.tolist(), last.tolist(), strict=True)]  # runs on over the tuple's bytes
            self._add(at, index, counts, hashes)

    def _add(self, at: np.ndarray, index: np.ndarray, counts: np.ndarray, hashes: list[int]) -> None:
        self.grams.append((self.doc[at], index, counts, np.array(hashes, np.int64) % self.buckets))

    def bucket_counts(self) -> np.ndarray:
        return sum(np.bincount(bucket, counts, self.buckets) for _, _, counts, bucket in self.grams).astype(np.int64)

    def features(self) -> np.ndarray:
        return sum(np.bincount(doc, minlength=len(self.lengths)) for doc, *_ in self.grams)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its n-grams' buckets' values, exact as whole numbers below 2**53."""
        return sum(np.bincount(doc, values[bucket][index], len(self.lengths)) for doc, index, _, bucket in self.grams).astype(np.int64)


def blocks(texts: pa.Array, orders: int, buckets: int) -> Iterator[Block]:
    """The texts in turn, cut into blocks of about BLOCK_BYTES."""
    held, size = [], 0
    for text in as_bytes(texts):
        if held and size + len(text) > BLOCK_BYTES:
            yield Block(held, orders, buckets)
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield Block(held, orders, buckets)


def bucket_counts(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket that has any; a task sends a row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text"), orders, buckets):
                total += block.bucket_counts()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return texts.select(text_of().alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: 1000 * ln of the target's smoothed share over that of docs, floored."""
    counts = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    for name, texts in (("s", docs), ("t", target)):
        counts = counts.join(bucket_counts(texts, orders, buckets).withColumnRenamed("n", name), "bucket", "left").fillna(0, [name])
    number = lambda c: F.col(c).cast("double")
    total = lambda c: F.sum(c).over(Window.partitionBy()).cast("double")  # noqa: E731  # over `buckets` rows
    ratio = (number("t") + 1) * (total("s") + buckets) / ((number("s") + 1) * (total("t") + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """docs, without text, with n_words, n_features, weight, score and rank; drawn rows have a rank from 1, all others null.

    weight is the mean gain of a document's n-grams towards the texts of target; score adds seeded Gumbel noise, so the `share` in
    100 highest scores among documents of least_words or more are a weighted draw without replacement. Ties go to the
    smaller doc_id, null last, and then to any of such rows. The gains are `buckets` numbers, which go to the driver and all tasks.
    Ranks come from one range sort: a row's place in its range and the sizes of ranges before it (a row each).
    Null texts have no words and weight 0; an empty table, on either side, gives counts of 0; texts are read whole in 8 bytes a
    word; copies of a row come back each; own columns of the new names are replaced, all others are kept whatever their names.
    """
    gained = bucket_gains(docs, target, orders, buckets).collect()  # `buckets` rows
    gains = np.zeros(buckets, np.float64)
    gains[[r["bucket"] for r in gained]] = [r["gain"] for r in gained]
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(text: pa.Array) -> pa.Array:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for block in blocks(text, orders, buckets):
            features = block.features()
            for column, values in zip(out, (block.lengths, features, block.sums(shared.value) // np.maximum(features, 1)), strict=True):
                column.append(values)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["n_words", "n_features", "weight"])

    own = F.struct("doc_id", *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", *NEW)]).alias("row")
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    place = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(place)))
    scored = docs.select(own, weigh(text_of()).alias("told")).select("row", "told", (F.col("told.weight") + noise).alias("score"), F.monotonically_increasing_id().alias("seat"))
    scored = settle(scored, "scored")
    in_order = scored.filter(F.col("told.n_words") >= least_words).orderBy(F.desc("score"), F.asc_nulls_last("row.doc_id"), "seat")
    placed = settle(in_order.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "placed")  # the id's high bits number the range
    ranges = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    ranges = ranges.select("part", F.coalesce(before, F.lit(0)).alias("before"), F.floor(F.sum("rows").over(Window.partitionBy()) * share / 100).alias("drawn"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.join(F.broadcast(ranges), "part").withColumn("rank", F.when(rank <= F.col("drawn"), rank))
    rest = scored.filter(F.col("told.n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select("row", "told", "score", "rank").unionByName(rest.select("row", "told", "score", "rank")).select("row.*", "told.*", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each document towards the benchmark's texts; see resample()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


OP11_SQL = r"""
WITH RECURSIVE crc(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
texts AS (SELECT 'd' AS side, row_number() OVER () AS seat, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
worded AS (
  SELECT side, seat, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, seat, unnest(w) AS g FROM worded UNION ALL
  SELECT side, seat, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded WHERE len(w) > 1),
hexed AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)),
hashed AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM hexed, steps),
told AS (SELECT side, seat, bucket FROM grams JOIN hashed USING (g)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM told GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT seat, count(*)::BIGINT AS n_features, sum(gain) AS total FROM told JOIN gains USING (bucket) WHERE side = 'd' GROUP BY seat),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
    ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM worded LEFT JOIN weights USING (seat) WHERE side = 'd'),
drawn AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (
  SELECT doc_id, n_words, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, floor(25 * count(*) OVER () / 100) AS most FROM drawn WHERE n_words >= 20)
SELECT d.doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank, d.n_words FROM drawn d LEFT JOIN ranked r ON r.doc_id = d.doc_id
"""

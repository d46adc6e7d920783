"""SimHash near copies: an inverted index over the bytes of fingerprints, by position, counts the bytes that pairs share."""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import as_bytes, discard, settle, text_of, word_pieces
from .near_duplicates import _pairs, _roots, components

SHINGLE, SEED, MOST_BITS = 4, 42, 4
BYTES = 8
#: A pair that differs in MOST_BITS bits has this many equal bytes at least.
LEAST_SHARED = BYTES - MOST_BITS
#: Fingerprints that one list of the index may hold before it's split by one byte more, and that one side of a block may hold
#: where such a list is too long again.
LIST = 1024
#: Rows that one task compares about, many lists together, and pairs that it looks at at once.
BUCKET_ROWS, AT_ONCE = 8_000, 200_000
#: A key with over one part in so many of all rows is hot; there are no more such keys than this, so they can be broadcast.
HOT = 1000
#: White space is a blank, A-Z are lower-cased.
_FOLD = bytes(32 if 9 <= b <= 13 else b for b in bytes(range(256)).lower())


def triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions of which any four positions hold one: the positions lie in three groups in a ring, and taken are
    three of one group, or two of one and one of the next."""
    group = [p * 3 // BYTES for p in range(BYTES)]

    def taken(t: tuple[int, ...]) -> bool:
        held = [sum(group[p] == g for p in t) for g in range(3)]
        return 3 in held or any(held[g] == 2 and held[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in combinations(range(BYTES), 3) if taken(t)]


def _mask(positions: tuple[int, ...]) -> int:
    mask = reduce(int.__or__, (255 << 8 * p for p in positions))
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's runs of four words, repeats counted, as a signed number; 0 without words."""
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    ones, n, held = np.zeros(64, np.int64), 0, []
    for words in word_pieces(text.translate(_FOLD)):
        held += words
        size = len(held) - SHINGLE + 1
        if size > 0:
            shingles = zip(*(held[k : size + k] for k in range(SHINGLE)), strict=True)
            hashes = np.fromiter(map(digest, map(b" ".join, shingles)), np.uint64, size)
            ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n, held = n + size, held[size:]
    if not n:
        whole = digest(b" ".join(held)) if held else 0
        return whole - (1 << 64) if whole >> 63 else whole
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.arrow_udf(LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in as_bytes(text)], pa.int64())


def join_hot(rows: DataFrame, table: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """rows joined to table, which has a row for each value of `on` and in `size` how many of the total rows have it.

    Values with over a HOT-th of all rows, HOT at most, are broadcast; the shuffle has none with more.
    """
    hot = F.col(size) * HOT > total
    few = F.broadcast(table.filter(hot))
    return rows.join(few, on).unionByName(rows.join(few.select(on), on, "left_anti").join(table.filter(~hot), on))


def _listed(keys: DataFrame, name: str) -> DataFrame:
    """The rows of keys (id, node, ...) whose id has several, with n, how many; settled."""
    held = settle(keys, "index")
    sizes = settle(held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = settle(join_hot(held, sizes, "id", "n", total), name)
    discard(held)
    discard(sizes)
    return out


def _keyed(mask: Column) -> Column:
    return F.xxhash64(mask, F.col("node").bitwiseAND(mask))


def _linked(table: pa.Table) -> pa.Table:
    """Links among the lists of a bucket as a star a component: (a, b), b being its least fingerprint."""
    table = table.sort_by([(c, "ascending") for c in ("id", "i", "j")])
    ids, i, j, nodes, part = (table.column(c).to_numpy() for c in ("id", "i", "j", "node", "part"))
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    own, place = np.unique(nodes, return_inverse=True)
    root = every = np.arange(len(own))
    for x, y in _pairs(np.diff(np.append(new, len(ids)))):
        keep = (i[x] == j[x]) | (part[x] != part[y])
        x, y = x[keep], y[keep]
        differing = (nodes[x] ^ nodes[y]).view(np.uint64)
        shared = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        keep = shared >= LEAST_SHARED
        x, y, differing = x[keep], y[keep], differing[keep]
        keep = np.bitwise_count(differing) <= MOST_BITS
        root = _roots(len(own), np.concatenate([every, place[x[keep]]]), np.concatenate([root, place[y[keep]]]))
    out = np.flatnonzero(root != every)
    return pa.table([pa.array(own[out], pa.int64()), pa.array(own[root[out]], pa.int64())], ["a", "b"])


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that span each component of nodes (node: distinct fingerprints) at MOST_BITS differing bits or fewer.

    Two such fingerprints share LEAST_SHARED of their bytes by position, so they meet in the list of one of the triples at
    least. A list of over LIST is split by each of the other positions, where they share one more byte; one that is too long
    again is compared block with block. In a list the shared bytes of each pair are tallied, pairs below
    the least are dropped, and the differing bits of the rest are counted. No pair is shipped, only a star a component.
    """
    masks = [_mask(t) for t in triples()]
    keys = nodes.select("node", F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), _keyed(F.lit(m)).alias("id")) for m in masks])).alias("key"))
    lists = _listed(keys.select("node", "key.mask", "key.id"), "lists")
    singles = F.array(*[F.lit(_mask((p,))) for p in range(BYTES)])
    fuller = lists.filter(F.col("n") > LIST).select("node", "mask", F.explode(singles).alias("byte")).filter(F.col("mask").bitwiseAND(F.col("byte")) == 0)
    fuller = fuller.select("node", F.col("mask").bitwiseOR(F.col("byte")).alias("mask")).distinct()
    split = _listed(fuller.select("node", "mask", _keyed(F.col("mask")).alias("id")), "split")
    whole = lists.filter(F.col("n") <= LIST).unionByName(split.filter(F.col("n") <= LIST))
    zero = F.lit(0)
    whole = whole.select("id", "node", zero.alias("part"), zero.alias("i"), zero.alias("j"))
    parts = F.ceil(F.col("n") / LIST).cast("int")
    dealt = split.filter(F.col("n") > LIST).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("id", "node", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    rows = settle(whole.unionByName(dealt), "compared")
    buckets = rows.count() // BUCKET_ROWS + 1
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "i", "j"), F.lit(buckets)))
    found = settle(bucketed.groupBy("bucket").applyInArrow(_linked, "a long, b long"), "found")
    for done in (lists, split, rows):
        discard(done)
    return found


def near_copies(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked if their fingerprints differ in MOST_BITS bits or fewer; component_id is the least doc_id that links lead to,
    its own included. Null and empty texts, and texts of white space, have fingerprint zero, linked like any other. Equal
    fingerprints are one node of the graph. A null doc_id is never a component_id unless all of a component are null; rows that
    repeat an id are rows of their own; copies of a row come back each, an empty table empty; other columns of docs aren't read. Texts
    are read whole, in pieces.
    """
    printed = settle(docs.select("doc_id", _fingerprints(text_of()).alias("node")), "printed")
    nodes = settle(printed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "nodes")
    found = links(nodes.select("node"))
    stars = settle(components(found), "stars")
    least_of = nodes.join(stars, "node", "left").select(F.coalesce("root", "node").alias("root"), "node", "rep", "copies")
    rooted = settle(least_of, "rooted")
    least = settle(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    n_nodes, n_docs = rooted.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    by_node = settle(join_hot(rooted, least, "root", "n", n_nodes).select("node", "component_id", "copies"), "by_node")
    for done in (nodes, found, stars, rooted, least):
        discard(done)
    return join_hot(printed, by_node, "node", "copies", n_docs).select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document; see near_copies()."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

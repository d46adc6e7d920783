"""N-gram Jaccard join: MinHash bands give pairs, Bayesian pruning drops the hopeless ones, exact sets settle the rest."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, per_batch, settle

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band of ROWS values but for 1 in 17,000 pairs; at 0.9, but for less than 1 in 10**10.
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
#: Candidates of similar posterior below this chance of reaching the threshold are dropped, tested each STEP values.
TOLERANCE, STEP = 1e-9, 32
#: Signatures that one side of a block of a band's key holds, and texts that one side of a block of a group of survivors holds;
#: larger groups are compared block by block. A block also has SHINGLES shingles a side at most, but for a longer text alone.
GROUP, BLOCK, SHINGLES = 1024, 64, 1_000_000
#: Rows of signatures that one task compares about, many small groups together, and pairs that it looks at at once.
BUCKET_ROWS, AT_ONCE = 8_000, 200_000
#: How many ways the rows of one key are dealt where a key may be hot.
SALTS = 8

_U64 = np.uint64
_ODD = np.random.default_rng(41).integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class Shingler:
    """Distinct hashed shingles of texts: runs of SHINGLE white-space words, A-Z lower-cased; a shorter text is one shingle."""

    _BASE = 0x9E3779B97F4A7C15
    _BACK = pow(_BASE, -1, 1 << 64)

    def __init__(self):
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self._up, self._down = (np.cumprod(np.concatenate([[_U64(1)], np.full(size - 1, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_U64(self._BASE), _U64(self._BACK)))

    def __call__(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text.lower(), dtype=np.uint8)
        inside = np.concatenate([[False], ~_SPACE[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        self._powers(len(raw))
        sums = np.concatenate([[_U64(0)], np.cumsum((raw.astype(np.uint64) + _U64(1)) * self._up[: len(raw)], dtype=np.uint64)])
        words = _mixed((sums[ends] - sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))
        size = min(SHINGLE, len(words))
        runs = np.full(len(words) - size + 1, _U64(size))
        for i in range(size):
            runs = _mixed(runs + words[i : len(words) - size + 1 + i])
        return np.unique(runs)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values, of which 16 bits are kept: two that differ look equal once in 65,536, which only keeps a pair."""
    low = (shingles >> _U64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, (low[at : at + 2048] * _ODD[:, None]).min(axis=1), out=out)
    return out.astype(np.uint16)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A key for each band of each signature (rows of HASHES values)."""
    keys = np.zeros((len(sigs), BANDS), dtype=np.uint64)
    for column in np.moveaxis(sigs.reshape(-1, BANDS, ROWS), 2, 0):
        keys = _mixed(keys * _U64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + _U64(1))
    return keys


def node_of(shingles: np.ndarray) -> int:
    """The fingerprint of a shingle set: texts with equal sets are one node of the join."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def needed_matches(step: int = STEP, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each n of compared values the fewest matches m that keep a pair.

    With a uniform prior the similarity's posterior is Beta(m + 1, n - m + 1), and its chance of threshold or more is
    that of m or fewer successes in n + 1 trials at the threshold.
    """
    out = {}
    for n in range(step, HASHES + 1, step):
        chance = 0.0
        for m in range(n + 1):
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                out[n] = m
                break
    return out


def _survivors(sigs: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    small, large = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
    keep = small >= THRESHOLD * large - 1e-9
    x, y = x[keep], y[keep]
    matched = np.zeros(len(x), dtype=np.int32)
    for n, least in needed_matches().items():
        matched += (sigs[x, n - STEP : n] == sigs[y, n - STEP : n]).sum(axis=1, dtype=np.int32)
        keep = matched >= least
        x, y, matched = x[keep], y[keep], matched[keep]
    return x, y


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles each pair shares, exactly: by merging for few pairs, by blocks of a matrix product for many."""
    if len(x) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype=np.int64)
    used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    rows = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    ids, counts = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)[1:]
    shared = counts > 1
    rank = np.cumsum(shared) - 1
    keep = shared[ids]
    rows, ids = rows[keep], rank[ids[keep]]
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    total = np.zeros((len(used), len(used)), dtype=np.float64)
    width = 2048
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(ids, [at, at + width])
        block = np.zeros((len(used), width), dtype=np.float32)
        block[rows[lo:hi], ids[lo:hi] - at] = 1
        total += block @ block.T
    half = len(x)
    return total[back[:half], back[half:]].astype(np.int64)


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, HASHES)


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each one's component under the links x, y."""
    root = np.arange(n)
    while len(x) and (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
    return root


def _pairs(sizes: np.ndarray):
    """Index pairs x < y within consecutive groups of so many rows, about AT_ONCE at a time."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    after = ends - 1 - np.arange(len(ends))
    sums = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(after):
        stop = max(at + 1, int(np.searchsorted(sums, sums[at] + AT_ONCE, side="right")) - 1)
        x = np.repeat(np.arange(at, stop), after[at:stop])
        yield x, x + 1 + np.arange(len(x)) - np.repeat(sums[at:stop] - sums[at], after[at:stop])
        at = stop


def _prune_groups(table: pa.Table) -> pa.Table:
    """Survivors among the pairs of all groups of a bucket, as a star a component: (a, b), b being its least row.

    A group is what shares a band's key, or one block of it. A pair that shares several bands is looked at in its first only.
    """
    table = table.sort_by([(c, "ascending") for c in ("id", "i", "j", "node")])
    ids, i, j = (table.column(c).to_numpy() for c in ("id", "i", "j"))
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    nodes, part, band, size = (table.column(c).to_numpy() for c in ("node", "part", "band", "size"))
    sigs = _signatures(table.column("sig"))
    keys = band_keys(sigs)
    own, place = np.unique(nodes, return_inverse=True)
    root = every = np.arange(len(own))
    for x, y in _pairs(np.diff(np.append(new, len(ids)))):
        keep = (i[x] == j[x]) | (part[x] != part[y])
        x, y = x[keep], y[keep]
        for t in range(int(band[x].max()) if len(x) else 0):
            keep = (band[x] <= t) | (keys[x, t] != keys[y, t])
            x, y = x[keep], y[keep]
        x, y = _survivors(sigs, size, x, y)
        root = _roots(len(own), np.concatenate([every, place[x]]), np.concatenate([root, place[y]]))  # survivors aren't held
    out = np.flatnonzero(root != np.arange(len(own)))
    return pa.table([pa.array(own[out], pa.int64()), pa.array(own[root[out]], pa.int64())], ["a", "b"])


def _compare_block(table: pa.Table) -> pa.Table:
    """Links among the texts of one block: for each linked node its links' copies, its links, and a node of its component.

    Compared are the pairs that share a band and that pruning keeps.
    """
    table = table.sort_by("node")
    nodes, parts, copies, sizes = (table.column(c).to_numpy() for c in ("node", "part", "copies", "size"))
    names = ["node", "links", "texts", "hub"]
    x, y = np.triu_indices(len(nodes), 1)
    if table.column("i")[0].as_py() != table.column("j")[0].as_py():
        across = parts[x] != parts[y]
        x, y = x[across], y[across]
    sigs = _signatures(table.column("sig"))
    keys = band_keys(sigs)
    banded = np.zeros(len(x), dtype=bool)
    for t in range(BANDS):
        banded |= keys[x, t] == keys[y, t]
    x, y = _survivors(sigs, sizes, x[banded], y[banded])
    if not len(x):
        return pa.table({c: pa.array([], pa.int64()) for c in names})
    shingle, used = Shingler(), np.zeros(len(nodes), dtype=bool)
    used[x] = used[y] = True
    sets = [shingle(text) if use else np.zeros(0, np.uint64) for text, use in zip(as_bytes(table.column("text").combine_chunks()), used, strict=True)]
    both = _common(sets, x, y)
    linked = both >= THRESHOLD * (sizes[x] + sizes[y] - both) - 1e-9
    x, y = x[linked], y[linked]
    links, texts = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    for a, b in ((x, y), (y, x)):
        np.add.at(links, a, copies[b])
        np.add.at(texts, a, 1)
    out = np.flatnonzero(texts)
    return pa.table([pa.array(c, pa.int64()) for c in (nodes[out], links[out], texts[out], nodes[_roots(len(nodes), x, y)[out]])], names)


def _salt(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(SALTS)).cast("int")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for all but the roots of the graph of edges (a, b), by turns of large and small stars.

    Each round hangs every node's larger neighbours, then the rest, on its least one, until nothing moves; all rounds
    are joins on salted keys, as a hub may have a third of all nodes, and each is written before the next.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        least = _salted(pairs.groupBy("a").agg(F.min("b").alias("low")))
        return pairs.withColumn("salt", _salt("b")).join(least, ["a", "salt"]).select("a", "b", F.least("a", "low").alias("low"))

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = mark(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = lowest(both).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = lowest(large)
        small = down.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(down.select("a", F.col("low").alias("b"))).distinct()
        after = settle(small, "stars")
        discard(now)
        before, now, state = state, after, mark(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _addressed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs with key and mark, hashes of id and text and of the text, that tell a row of docs without a null."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text").alias("mark"), *more)


def with_signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, mark, node, size, sig) of docs (doc_id, text): node is the fingerprint of the text's shingle set (null: no
    words), size its shingles, sig its signature. Texts of any length are read whole."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        shingle = Shingler()

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column("text"):
                s = shingle((text.as_py() or "").encode())
                rows.append((node_of(s), len(s), signature(s).tobytes()) if len(s) else (None, 0, None))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "mark")), *columns], ["doc_id", "key", "mark", "node", "size", "sig"])

        return turn

    return _addressed(docs).mapInArrow(per_batch(make), f"doc_id {kind}, key long, mark long, node long, size long, sig binary")


def _blocked(rows: DataFrame) -> DataFrame:
    """rows with part and parts, once for each block (i, j) of parts that they are in."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts")


def surviving_groups(keyed: DataFrame) -> DataFrame:
    """(node, root) of all nodes of keyed (node, size, sig) that have a pair left after pruning, grouped by such pairs.

    Pairs are those of one band's key. Groups of up to GROUP nodes that several bands share are looked at once; larger ones
    are cut into blocks. Only signatures are shipped, and only of nodes that share a band.
    """
    values = F.expr(f"substring(sig, {2 * ROWS} * band + 1, {2 * ROWS})")
    in_bands = keyed.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select("node", "band", F.xxhash64("band", values).alias("id"))
    counts = in_bands.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = settle(in_bands.withColumn("salt", _salt("node")).join(_salted(counts), ["id", "salt"]).drop("salt"), "shared")
    lists = shared.filter(F.col("n") <= GROUP).groupBy("id").agg(F.first("band").alias("band"), F.sort_array(F.collect_list("node")).alias("nodes"))
    lists = lists.groupBy("nodes").agg(F.min("band").alias("band"), F.min("id").alias("id"))
    zero = F.lit(0)
    small = lists.select("id", "band", F.explode("nodes").alias("node"), zero.alias("part"), zero.alias("i"), zero.alias("j"))
    large = _blocked(shared.filter(F.col("n") > GROUP).withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int"))).select(*small.columns)
    rows = settle(small.unionByName(large), "groups")
    buckets = rows.count() // BUCKET_ROWS + 1
    signed = rows.join(keyed.select("node", "size", "sig"), "node").withColumn("bucket", F.pmod(F.xxhash64("id", "i", "j"), F.lit(buckets)))
    edges = signed.groupBy("bucket").applyInArrow(_prune_groups, "a long, b long")
    stars = components(edges)
    out = settle(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "survivors")
    for done in (shared, rows):
        discard(done)
    return out


def _classified(docs: DataFrame) -> DataFrame:
    """similar()'s rows with key and mark."""
    signed = settle(with_signatures(docs), "signed")
    classes = signed.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct("key", "mark")).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"),
    )
    keyed = settle(classes, "classes")
    groups = surviving_groups(keyed)
    members = groups.join(keyed, "node")
    weights = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / SHINGLES)).cast("int").alias("parts"))
    members = members.withColumn("salt", _salt("node")).join(_salted(weights), ["root", "salt"]).drop("salt")
    reps = members.select("node", F.col("at.key").alias("key"), F.col("at.mark").alias("mark"))
    texts = _addressed(docs).join(reps, ["key", "mark"]).groupBy("node").agg(F.first("text").alias("text"))
    blocks = _blocked(members.select("root", "parts", "node", "copies", "size", "sig").join(texts, "node"))
    found = settle(blocks.groupBy("root", "i", "j").applyInArrow(_compare_block, "node long, links long, texts long, hub long"), "links")
    classes_of = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    summed = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("n_texts"))
    rooted = keyed.select("node", "rep", "copies").join(summed, "node", "left").join(classes_of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_node = settle(
        rooted.join(least, "root").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts")), "nodes"
    )
    for done in (keyed, groups, found):
        discard(done)
    dealt = signed.drop("size", "sig").withColumn("salt", _salt("key"))
    return dealt.join(_salted(by_node), ["node", "salt"], "left").select(
        "doc_id", "key", "mark", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
    )


def similar(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, node, class_id, n_links, n_texts.

    Two documents are linked if the Jaccard similarity of their five-word shingles is 0.8 or more. n_links counts a
    document's links, copies included; n_texts counts the different texts among them. class_id is the least doc_id of its
    component of links; a text without words (null, empty) has no link, no node and is its own class. Equal texts are one
    node, compared once. Pairs come from the bands and are pruned on signatures; texts are fetched for groups of survivors only,
    and such a group is cut into blocks of BLOCK texts and compared block with block, so a group of any size is done in full
    without a row for each pair. Null ids are never a class_id unless all of a class are null; rows that repeat an id are rows
    of their own; copies of a row come back each, an empty table empty; other columns of docs aren't read.
    """
    return _classified(docs).drop("key", "mark")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, with its columns, of which one document of each class stays: that of the least doc_id.

    Of rows that repeat an id and a text one stays, and of texts of one id that differ in case or white space only; texts
    without words all stay. An empty table stays empty. Own columns keep their values whatever they are called.
    """
    winners = (
        _classified(docs).filter(F.col("node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
        .groupBy("doc_id", "node").agg(F.min(F.struct("key", "mark")).alias("at")).select("at.key", "at.mark")
    )
    marked = _addressed(docs, F.struct("*").alias("row"))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = marked.filter(wordy).select("key", "mark", "row").join(winners, ["key", "mark"], "left_semi").groupBy("key", "mark").agg(F.first("row").alias("row"))
    return kept.select("row").unionByName(marked.filter(~wordy).select("row")).select("row.*")


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class and links of each document; see similar()."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_texts")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w WHERE len(w) > 0),
classes AS (SELECT min(doc_id) AS rep, count(*) AS copies, s FROM sets GROUP BY s),
flat AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM flat a JOIN flat b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM pairs WHERE shared * 5 >= (na + nb - shared) * 4),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
comp AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
deg AS (SELECT s.a AS rep, sum(c.copies) AS links, count(*) AS texts FROM sym s JOIN classes c ON c.rep = s.b GROUP BY s.a)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(deg.links, 0)::BIGINT + coalesce(c.copies - 1, 0) AS n_links, coalesce(deg.texts, 0)::BIGINT AS n_texts
FROM documents d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN classes c ON c.s = sets.s LEFT JOIN comp k ON k.rep = c.rep LEFT JOIN deg ON deg.rep = c.rep
"""

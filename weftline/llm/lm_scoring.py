"""LM scoring: a trigram model in sharded Elias-Fano tries, asked by blocks of documents for what they hold only."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_crc, settle
from .ngram_trie import PRINT_BITS, Trie, dequantise

#: Bytes of text that a block of documents has about, and bytes of text that a shard of the model stands for.
BLOCK_BYTES, SHARD_BYTES = 6_000_000, 9_000_000
#: A word with this share of all tokens is hot: what follows it is dealt to SLICES shards by the successor. There are at most
#: 1 / HOT_SHARE such words.
HOT_SHARE, SLICES = 0.0005, 16
#: What absolute discounting takes off each count of a trigram and of a bigram.
DISCOUNT = 0.75
#: The end of a text as a word, and what stands before its first; no word has white space.
END, BEGIN = b"\n", b"\r"

_U64 = np.uint64
_MASK = _U64((1 << PRINT_BITS) - 1)


def _flat(parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of an array of lists one after another, empty ones left out, and how many each list has."""
    words = parts.flatten().cast(pa.binary())
    full = pc.greater(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    return words.filter(full), np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(parts))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The white-space words of all texts, A-Z lower-cased, and how many each text has."""
    return _flat(pc.ascii_split_whitespace(pc.ascii_lower(texts)))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


@dataclass(frozen=True)
class Layout:
    """How many shards there are, and the hot contexts in the order of a block's words, BEGIN last."""

    shards: int
    hot: tuple[bytes, ...]


class Block:
    """What a set of documents asks of each shard, in an order that doesn't hang on the order of the documents."""

    def __init__(self, texts: pa.Array, train: np.ndarray, layout: Layout):
        flat, lengths = words_of(texts)
        coded = flat.dictionary_encode()
        found = pa.concat_arrays([coded.dictionary, pa.array([END])])
        order = pc.array_sort_indices(found).to_numpy()
        self.words = found.take(pa.array(order)).to_pylist()
        n = len(self.words)
        place_of = np.empty(n, dtype=np.int64)
        place_of[order] = np.arange(n)
        self.end = int(place_of[-1])
        stops = np.cumsum(lengths + 1) - 1
        ids = np.full(len(flat) + len(texts), self.end, dtype=np.int64)
        inner = np.ones(len(ids), dtype=bool)
        inner[stops] = False
        ids[inner] = place_of[coded.indices.to_numpy()]
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        self.starts = np.concatenate([[0], stops[:-1] + 1])
        before[self.starts] = n
        earlier = np.empty_like(ids)
        earlier[1:] = before[:-1]
        earlier[self.starts] = n
        self.ids, self.before = ids, before
        learnt = np.repeat(train, lengths + 1)
        self.word_counts = np.bincount(ids[learnt], minlength=n).astype(np.uint32)
        hashes = _hashes([*self.words, BEGIN])
        pairs, of_pair = np.unique(before * (n + 1) + earlier, return_inverse=True)
        grams, self.gram_of = np.unique(of_pair * n + ids, return_inverse=True)
        counts = np.bincount(self.gram_of[learnt], minlength=len(grams)).astype(np.uint32)
        middle, first = np.divmod(pairs[grams // n], n + 1)
        last = grams % n
        prints = hashes >> _U64(64 - PRINT_BITS)
        self.hot = np.full(n + 1, -1, dtype=np.int64)
        for i, w in enumerate(layout.hot):
            at = n if w == BEGIN else bisect_left(self.words, w)
            if at == n or self.words[at] == w:
                self.hot[at] = i
        self.slice = (prints[:n] % _U64(SLICES)).astype(np.int64)
        is_hot = self.hot[middle] >= 0
        shard = np.where(is_hot, sliced(hashes[middle], prints[last]) >> _U64(11), hashes[middle]) % _U64(layout.shards)
        self.word_shard = (hashes[:n] % _U64(layout.shards)).astype(np.int64)
        self.word_order = np.argsort(self.word_shard, kind="stable")
        # trigrams stand by their middle words; in a shard those of its own words come first, then the hot, both as they stood
        place = shard * _U64(2) + is_hot
        self.gram_order = np.argsort(place.astype(np.uint16 if layout.shards < 1 << 15 else np.int64), kind="stable")
        self.gram_shard = shard[self.gram_order].astype(np.int64)
        self._parts = np.where(is_hot, n + 1 + self.hot[middle], middle), prints[first] << _U64(PRINT_BITS) | prints[last], counts

    def questions(self, layout: Layout):
        """(shard, words, word_counts, runs, hot, hot_runs, keys, counts, large) for each shard that is asked anything.

        keys are the prints of a trigram's first and last word, in 7 bytes; a count of 255 or more stands in large.
        """
        middle, keys, counts = (p[self.gram_order] for p in self._parts)
        n = len(self.words)
        shards = np.arange(layout.shards + 1)
        word_cut = np.searchsorted(self.word_shard[self.word_order], shards)
        gram_cut = np.searchsorted(self.gram_shard, shards)
        narrow = keys.view(np.uint8).reshape(-1, 8)[:, :7]
        for s in np.flatnonzero((np.diff(word_cut) > 0) | (np.diff(gram_cut) > 0)):
            own = self.word_order[word_cut[s] : word_cut[s + 1]]
            a, b = gram_cut[s], gram_cut[s + 1]
            plain = a + int(np.searchsorted(middle[a:b], n + 1))
            runs = np.zeros(len(own), dtype=np.uint32)
            found, size = np.unique(middle[a:plain], return_counts=True)
            runs[np.searchsorted(own, found)] = size
            hot, hot_runs = np.unique(middle[plain:b] - n - 1, return_counts=True)
            c = counts[a:b]
            yield (
                int(s), b" ".join(self.words[i] for i in own), self.word_counts[own].tobytes(), runs.tobytes(), hot.astype(np.uint16).tobytes(),
                hot_runs.astype(np.uint32).tobytes(), np.ascontiguousarray(narrow[a:b]).tobytes(), np.minimum(c, 255).astype(np.uint8).tobytes(), c[c >= 255].tobytes(),
            )


def sliced(hashes: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The key of a hot word's slice, by the print of the successor."""
    return hashes + (prints % _U64(SLICES) + _U64(1)) * _U64(0x9E3779B97F4A7C15)


_ASKED = "shard int, block int, words binary, word_counts binary, runs binary, hot binary, hot_runs binary, keys binary, counts binary, large binary"
_TOLD = "shard int, block int, word_counts binary, codes binary, sums array<long>, hot array<struct<word:int,slice:int,n:long>>"


def _asked(row: dict, own: np.ndarray, hot_hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(middle, key, count, hot) of each trigram of a message: keys of middle words or slices, and the hot word's number or -1."""
    raw = np.frombuffer(row["keys"], np.uint8).reshape(-1, 7)
    keys = np.zeros((len(raw), 8), dtype=np.uint8)
    keys[:, :7] = raw
    keys = keys.view(np.uint64)[:, 0]
    counts = np.frombuffer(row["counts"], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(row["large"], np.uint32)
    hot = np.repeat(np.frombuffer(row["hot"], np.uint16).astype(np.int64), np.frombuffer(row["hot_runs"], np.uint32))
    plain = np.repeat(own, np.frombuffer(row["runs"], np.uint32))
    slices = sliced(hot_hashes[hot], keys[len(plain) :] & _MASK)
    return np.concatenate([plain, slices]), keys, counts, np.concatenate([np.full(len(plain), -1), hot])


def _answer(table: pa.Table, layout: Layout) -> pa.Table:
    """One shard: sum what all blocks count, build the trie, and look up for each block the words and trigrams that it named."""
    table = table.sort_by("block")
    words, lengths = _flat(pc.split_pattern(table.column("words").combine_chunks(), " "))
    coded = words.dictionary_encode()
    word = coded.indices.to_numpy()
    rows = table.drop_columns(["words"]).to_pylist()
    named = np.frombuffer(b"".join(r["word_counts"] for r in rows), np.uint32)
    totals = np.bincount(word, weights=named, minlength=len(coded.dictionary)).astype(np.int64)
    known = _hashes(coded.dictionary.to_pylist())
    cuts = np.cumsum(lengths)[:-1]
    hot_hashes = _hashes(list(layout.hot))
    middle, keys, counts, hot = map(np.concatenate, zip(*(_asked(r, own, hot_hashes) for r, own in zip(rows, np.split(known[word], cuts), strict=True)), strict=True))
    sizes = [len(r["counts"]) for r in rows]
    order = np.lexsort((keys, middle))
    middle, keys, hot = middle[order], keys[order], hot[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (middle[1:] != middle[:-1]) | (keys[1:] != keys[:-1])
    sums = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(order) else counts
    middle, keys, hot = middle[new], keys[new], hot[new]
    first, last = keys >> _U64(PRINT_BITS), keys & _MASK
    seen = sums > 0
    trie = Trie(middle[seen], first[seen], last[seen], sums[seen], DISCOUNT)
    try:
        place = np.cumsum(new) - 1
        codes = np.empty((len(order), 2), dtype=np.uint8)
        for k, answer in enumerate(trie.ask(middle, first, last)):  # each is looked up once, however many blocks ask
            codes[order, k] = answer[place]
    finally:
        trie.close()
    slices = (hot.astype(np.int64) * SLICES + (last % _U64(SLICES)).astype(np.int64))[hot >= 0]
    found, back = np.unique(slices, return_inverse=True)
    hot_sums = np.bincount(back, weights=sums[hot >= 0], minlength=len(found)).astype(np.int64)
    of_slice = ((known >> _U64(64 - PRINT_BITS)) % _U64(SLICES)).astype(np.int64)
    own_sums = np.concatenate([np.bincount(of_slice, weights=w, minlength=SLICES) for w in (totals, totals > 0)]).astype(np.int64)
    blank = [None] * (len(rows) - 1)
    ends = np.cumsum(sizes)[:-1]
    columns = [
        pa.array([r["shard"] for r in rows], pa.int32()), pa.array([r["block"] for r in rows], pa.int32()), pa.array([w.tobytes() for w in np.split(totals[word], cuts)], pa.binary()),
        pa.array([c.T.tobytes() for c in np.split(codes, ends)], pa.binary()), pa.array([own_sums.tolist(), *blank], pa.list_(pa.int64())),
        pa.array([[{"word": int(f) // SLICES, "slice": int(f) % SLICES, "n": int(x)} for f, x in zip(found, hot_sums, strict=True)], *blank], pa.list_(pa.struct([("word", pa.int32()), ("slice", pa.int32()), ("n", pa.int64())]))),
    ]
    return pa.table(columns, [f.split()[0] for f in _TOLD.split(", ")])


def _tallied(tables: list[pa.Table]) -> pa.Table:
    """(word, n) tables added up by word."""
    return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def _measure(docs: DataFrame) -> tuple[int, int, tuple[bytes, ...]]:
    """Bytes of all texts, training tokens with their ends, and the hot words: exactly those with HOT_SHARE of all tokens.

    A stretch of a task, of a million different words about, names the words with half of HOT_SHARE of its own tokens. What it leaves unnamed of
    a hot word is under half of HOT_SHARE of all tokens, so a hot word's named counts reach the other half; 2 / HOT_SHARE words can do that. A second
    scan counts these exactly. So neither the order of the rows nor how they are cut into tasks makes a word hot.
    """

    def name(batches):
        found: Counter[bytes] = Counter()
        held: list[pa.Table] = []
        size = learnt = total = stretch = 0

        def close():
            nonlocal held, stretch
            if held:
                often = _tallied(held).filter(pc.field("n") >= HOT_SHARE / 2 * stretch).to_pydict()
                for word, n in zip(often["word"], often["n"], strict=True):
                    found[word] += n
            held, stretch = [], 0

        for batch in batches:
            words, lengths = words_of(batch.column("text"))
            own = lengths + 1
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            total += int(own.sum())
            stretch += int(own.sum())
            learnt += int(own[~batch.column("held_out").to_numpy(zero_copy_only=False)].sum())
            held.append(pa.table(words.value_counts().flatten(), ["word", "n"]))
            if sum(t.num_rows for t in held) > 2_000_000:
                held = [_tallied(held)]
                if held[0].num_rows > 1_000_000:
                    close()
        close()
        rows = [(b"", size, learnt, total), *((w, c, 0, 0) for w, c in found.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["word", "n", "learnt", "total"])

    sums = docs.mapInArrow(name, "word binary, n long, learnt long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt"), F.sum("total").alias("total"))
    sums = settle(sums, "tally")  # read twice, counted once
    whole = sums.filter(F.octet_length("word") == 0).first()
    if whole is None:
        return 0, 0, ()
    named = sums.filter((F.octet_length("word") > 0) & (F.col("n") >= HOT_SHARE / 2 * whole["total"])).select("word").collect()  # 2 / HOT_SHARE rows at most
    discard(sums)
    asked = docs.sparkSession.sparkContext.broadcast(pa.array(sorted(bytes(r["word"]) for r in named), pa.binary()))

    def count(batches):
        held: list[pa.Table] = []
        for batch in batches:
            words = words_of(batch.column("text"))[0]
            held.append(pa.table(words.filter(pc.is_in(words, asked.value)).value_counts().flatten(), ["word", "n"]))
            held = [_tallied(held)] if len(held) > 64 else held
        if held:
            yield from _tallied(held).to_batches()

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_SHARE * whole["total"])
    return whole["n"], whole["learnt"], (*sorted({END, *(bytes(r["word"]) for r in counted.collect())}), BEGIN)


def _read(table: pa.Table, layout: Layout) -> Block:
    return Block(table.column("text").combine_chunks(), ~table.column("held_out").to_numpy(), layout)


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score.

    Documents are dealt by hash to blocks. A block names its words and trigrams once, with what it counts among its training
    documents, to the shards that own the (middle) words; a shard adds up, builds its trie and answers each block with the
    words' counts and two codes for each trigram, from which the block scores its own texts. Nothing whole meets in one place.
    With counts n, types t and discount D, P(c | a b) = (n(abc) - D) / n(ab) + D t(ab) / n(ab) P(c | b), likewise P(c | b) over
    the base probability of c; each part is stored rounded down. After a hot b, the slice s of c comes first: P(s | b) =
    (n(b s) + 1) / (n(b) + SLICES), then all of the above among the words of s. So probabilities sum to no more than 1. Which words are hot is a matter
    of their exact counts, so scores don't hang on the order or the partitions of docs.
    Null text is empty and has its end only; texts of any length are whole, copies of rows come back each, an empty table gives
    none; other columns aren't read. Without training documents all counts are 0.
    """
    held = F.pmod(id_crc(), F.lit(7)) == 2
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    size, learnt, hot = _measure(given)
    layout = Layout(size // shard_bytes + 1, hot)
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = given.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // block_bytes + 1)).cast("int"))
    shared = docs.sparkSession.sparkContext.broadcast(layout)

    def ask(table: pa.Table) -> pa.Table:
        block = _read(table, shared.value)
        own = table.column("block")[0].as_py()
        rows = [(s, own, *rest) for s, *rest in block.questions(shared.value)]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 8]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in _ASKED.split(", ")])

    asked = dealt.groupBy("block").applyInArrow(ask, _ASKED)
    told = settle(asked.groupBy("shard").applyInArrow(lambda t: _answer(t, shared.value), _TOLD), "answers")
    sums = np.zeros(2 * SLICES)
    for r in told.select(F.posexplode("sums").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect():
        sums[r["pos"]] = r["n"]
    after = np.zeros((len(hot), SLICES))
    for r in told.select(F.explode("hot").alias("h")).groupBy("h.word", "h.slice").agg(F.sum("h.n").alias("n")).collect():
        after[r["word"], r["slice"]] = r["n"]
    whole, within = learnt + sums[SLICES:].sum() + 1, sums[:SLICES] + sums[SLICES:] + 1
    chances = docs.sparkSession.sparkContext.broadcast((after + 1) / (after.sum(axis=1, keepdims=True) + SLICES))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (left.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        block = _read(left, shared.value)
        right = right.sort_by("shard")
        counts = np.frombuffer(b"".join(right.column("word_counts").to_pylist()), np.int64)
        codes = np.concatenate([np.frombuffer(b, np.uint8).reshape(2, -1) for b in right.column("codes").to_pylist()], axis=1).T
        known = np.empty(len(block.words), dtype=np.float64)
        known[block.word_order] = counts
        grams = np.empty_like(codes)
        grams[block.gram_order] = codes
        share, weight = dequantise(grams[block.gram_of]).T
        n, hot_before = known[block.ids] + 1, block.hot[block.before]
        in_slice = block.slice[block.ids]
        base = n / whole
        own = np.where(hot_before >= 0, chances.value[hot_before, in_slice] * (share + weight * n / within[in_slice]), share + weight * base)
        by_doc = lambda x: np.add.reduceat(x, block.starts)
        out = [by_doc(np.ones(len(block.ids), dtype=np.int64)), by_doc((n > 1).astype(np.int64)), by_doc(np.log10(base)), by_doc(np.log10(own))]
        return pa.table([left.column("doc_id"), left.column("held_out"), *map(pa.array, out)], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    scored = dealt.groupBy("block").cogroup(told.select("shard", "block", "word_counts", "codes").groupBy("block")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(learnt).cast("long"))


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Base and model score of each document; see score_texts()."""
    rows = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

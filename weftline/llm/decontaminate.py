"""Benchmark decontamination: token windows of the corpus against a broadcast set of benchmark n-grams."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, per_batch, settle

#: On lower-cased UTF-8: the bytes of digits, letters and all that is not ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Benchmark characters that one broadcast set may hold, some 150 MB of arrays and words; a larger benchmark is matched in
#: several passes.
BLOCK_CHARS = 32_000_000


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class WindowSet:
    """Windows of n consecutive item words (an item with fewer is one window), found in texts by rolling hashes.

    All items' words are one array of word numbers. For each window size each different window stands once, sorted by hash: its hash, a place where
    it stands in the words, and the items that have it, as a stretch of a list. So a hit is verified once, on the words at that place, however often
    the benchmark repeats it.
    """

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.ids: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        numbers = [np.fromiter((self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)), dtype=np.uint32) for _, text in items]
        lengths = np.array([len(x) for x in numbers], dtype=np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint32), *numbers])
        starts = np.cumsum(lengths) - lengths
        #: By size: hashes, places, and where each window's items begin in the list that follows.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.minimum(lengths, n)
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            places = np.concatenate([starts[k] + np.arange(lengths[k] - size + 1) for k in own])
            of = np.repeat(own, lengths[own] - size + 1)
            hashes = np.concatenate([self._rolled(numbers[k].astype(np.uint64), size) for k in own])
            self.windows[size] = self._distinct(hashes, places, of, size)

    def _distinct(self, hashes: np.ndarray, places: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(hashes, kind="stable")
        hashes, places, of = hashes[order], places[order], of[order]
        entry = np.full(len(hashes), -1)
        first: list[np.ndarray] = []
        rest, n = np.arange(len(hashes)), 0
        while len(rest):  # once, and again for windows that share a hash with another
            heads = np.concatenate([[True], hashes[rest][1:] != hashes[rest][:-1]])
            head = rest[heads][np.cumsum(heads) - 1]
            same = self._equal(places[rest], self.words, places[head], size)
            entry[rest[same]] = (n + np.cumsum(heads) - 1)[same]
            first.append(rest[heads])
            n += int(heads.sum())
            rest = rest[~same]
        heads = np.concatenate(first)
        by_hash = np.argsort(hashes[heads], kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_hash] = np.arange(n)
        pairs = np.unique(np.column_stack([rank[entry], of]), axis=0)
        begins = np.searchsorted(pairs[:, 0], np.arange(n + 1))
        return hashes[heads][by_hash], places[heads][by_hash], begins, pairs[:, 1]

    def _equal(self, at: np.ndarray, words: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
        """Whether the `size` words from each of at are those from each of places on."""
        same = np.ones(len(at), dtype=bool)
        for i in range(size):
            same &= words[at + i] == self.words[places + i]
        return same

    def _rolled(self, ids: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(ids) - size + 1, dtype=np.uint64)
        for i in range(size):
            out = out * self._MIX + ids[i : len(ids) - size + 1 + i]
            out ^= out >> np.uint64(29)
        return out

    def search(self, text: bytes) -> tuple[int, np.ndarray | None, set]:
        """How many words; which are hit (None: none); the items that have an occurring window."""
        words = words_of(text)
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        marks, items = None, set()
        for size, (known, places, begins, lists) in self.windows.items():
            if len(ids) < size:
                continue
            gaps = np.flatnonzero(ids == 0)  # a window with a word that no item has can't occur
            if len(gaps) and len(gaps) * (size + 1) > len(ids) and np.diff(np.concatenate([[-1], gaps, [len(ids)]])).max() <= size:
                continue
            rolled = self._rolled(ids, size)
            entry = np.searchsorted(known, rolled)
            entry[entry == len(known)] = 0
            at = np.flatnonzero(known[entry] == rolled)
            entry = entry[at]
            while len(at):  # once, and again for windows that share a hash with another
                same = self._equal(at, ids, places[entry], size)
                if same.any():
                    marks = np.zeros(len(ids) + 1, dtype=np.int32) if marks is None else marks
                    np.add.at(marks, at[same], 1)
                    np.add.at(marks, at[same] + size, -1)
                    for e in np.unique(entry[same]).tolist():
                        items.update(lists[begins[e] : begins[e + 1]].tolist())
                hashes = known[entry]
                entry = entry + 1
                more = ~same & (entry < len(known)) & (known[np.minimum(entry, len(known) - 1)] == hashes)
                at, entry = at[more], entry[more]
        hit = None if marks is None else np.cumsum(marks[:-1]) > 0
        return len(words), hit, {self.items[i] for i in items}

    def cut(self, text: bytes, hit: np.ndarray) -> bytes:
        """text without the hit words and what stands between them."""
        keep, at, last_hit = [], 0, False
        for m, bad in zip(_WORD.finditer(text.lower()), hit, strict=True):
            if not bad:
                keep.append(text[m.start() if last_hit else at : m.end()])
            elif not last_hit:
                keep.append(text[at : m.start()])
            at, last_hit = m.end(), bool(bad)
        return b"".join([*keep, b"" if last_hit else text[at:]])


def _blocks(benchmark: DataFrame, n: int, block_chars: int):
    """Broadcast window sets, each of block_chars of the benchmark about, and whether it is the only one; one for any benchmark of usual size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // block_chars) or 1
    for k in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        rows = [(r["item"], r["text"].encode()) for r in own.toLocalIterator()]
        yield benchmark.sparkSession.sparkContext.broadcast(WindowSet(rows, n)), parts == 1


def _searched(docs: DataFrame, benchmark: DataFrame, n: int, block_chars: int) -> DataFrame:
    """(row, text, n_words, n_hit, items, clean_text) of each row of docs, whose other columns are inside row, so that no name clashes.

    Of several blocks each is one pass whose result is written, so a task never holds more than one.
    """
    names = ["row", "text", "n_words", "hit", "items"]
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    fresh = {"n_words": F.lit(None).cast("long"), "hit": F.lit(None).cast("binary"), "items": F.array().cast("array<string>")}
    out = docs.select(row.alias("row"), "text").withColumns(fresh)
    for block, alone in _blocks(benchmark, n, block_chars):

        def make(block=block):
            known = block.value

            def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
                counts, masks, items = [], [], []
                for text, mask, had in zip(as_bytes(batch.column("text")), batch.column("hit").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    size, hit, found = known.search(text)
                    if mask is not None:
                        before = np.unpackbits(np.frombuffer(mask, np.uint8), count=size).astype(bool)
                        hit = before if hit is None else hit | before
                    counts.append(size)
                    masks.append(None if hit is None else np.packbits(hit).tobytes())
                    items.append(sorted({*had, *(x for x in found if x is not None)}))
                new = [pa.array(counts, pa.int64()), pa.array(masks, pa.binary()), pa.array(items, pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *new], names)

            return turn

        searched = out.mapInArrow(per_batch(make), out.schema)
        if not alone:
            written = settle(searched, "searched")
            block.unpersist()
            discard(out)
            searched = written
        out = searched

    def finish():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_hit, clean = [], []
            for raw, mask, size in zip(as_bytes(batch.column("text")), batch.column("hit").to_pylist(), batch.column("n_words").to_pylist(), strict=True):
                hit = None if mask is None else np.unpackbits(np.frombuffer(mask, np.uint8), count=size).astype(bool)
                n_hit.append(0 if hit is None else int(hit.sum()))
                clean.append(None if hit is None else WindowSet.cut(None, raw, hit).decode("utf-8", "replace"))
            own = [batch.column(c) for c in ("row", "text", "n_words", "items")]
            return pa.RecordBatch.from_arrays([*own, pa.array(n_hit, pa.int64()), pa.array(clean, pa.string())], ["row", "text", "n_words", "items", "n_hit", "clean_text"])

        return turn

    shape = out.select("row", "text", "n_words", "items").withColumns({"n_hit": F.lit(0).cast("long"), "clean_text": F.lit(None).cast("string")}).schema
    for field in shape:
        field.nullable = True
    done = out.mapInArrow(per_batch(finish), shape)
    return done.withColumn("clean_text", F.coalesce("clean_text", "text"))


def _own(docs: DataFrame, text: str = "text", without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of docs out of a searched row, the text from the column so named."""
    return [F.col(text).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in without]


def find_windows(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids of items that have a window in the text) and clean_text.

    The benchmark is measured first: up to block_chars it is one broadcast set, beyond that several sets are passed over
    the documents in turn, each result written, which needs no shuffle either. Every hash hit is verified on the words themselves. Null text has
    no words; an empty benchmark hits nothing; items without words have no window; copies of an item share its windows; a
    null item_id hits but isn't listed. Texts of any length are searched whole; an empty table stays empty. A column of docs
    named like one of the new ones is replaced, all others stay as they are; order and copies stay.
    """
    new = ("n_words", "n_hit", "items", "clean_text")
    return _searched(docs, benchmark, n, block_chars).select(*_own(docs, without=new), *new)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, how: str = "documents") -> DataFrame:
    """docs with its own columns and without benchmark passages: how is "documents" (hit ones go) or "spans" (hit words go).

    All columns but, for spans, text keep their values whatever they are called. Null and empty texts are never hit; texts of any length are
    searched whole; copies of a row go or stay alike, an empty table stays empty.
    """
    if how not in ("documents", "spans"):
        raise ValueError(f"how is documents or spans, not {how}")
    found = _searched(docs, benchmark, n, BLOCK_CHARS)
    if how == "documents":
        return found.filter("n_hit = 0").select(*_own(docs))
    return found.select(*_own(docs, "clean_text"))


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of each document; see find_windows()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bwin),
dwin AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT d.doc_id, d.size, d.i, b.item FROM dwin d JOIN bwin b USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

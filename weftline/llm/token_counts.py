"""Token counts by a linear longest-match automaton: how many greedy pieces a text has, without building the pieces."""

from __future__ import annotations

import base64
from collections import Counter, deque
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level vocabularies of this kind part a text before they match.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of vocabulary that may be broadcast; public vocabularies have 0.5 to 5 MB.
MOST_BYTES = 64_000_000
#: Words whose counts a task remembers before it starts afresh.
REMEMBERED = 500_000


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file (base64, space, rank)."""
    with open(path, "rb") as lines:
        raw = lines.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} is over {MOST_BYTES} bytes and not broadcast")
    return [base64.b64decode(line.split()[0]) for line in raw.splitlines() if line.strip()]


@dataclass
class Automaton:
    """The vocabulary's trie as edge[node << 8 | byte]; fail[node] (-1: none) and popped[node], the pieces that its text
    up to fail[node] gives. Without a failure link the text can't go on, and the whole word counts as one unknown piece."""

    edge: dict[int, int]
    fail: list[int]
    popped: list[int]

    @classmethod
    def build(cls, pieces: list[bytes]) -> Automaton:
        edge: dict[int, int] = {}
        ends = [False]
        for piece in pieces:
            at = 0
            for byte in piece:
                to = edge.setdefault(at << 8 | byte, len(ends))
                if to == len(ends):
                    ends.append(False)
                at = to
            if piece:
                ends[at] = True
        below: dict[int, list[tuple[int, int]]] = {}
        for key, to in edge.items():
            below.setdefault(key >> 8, []).append((key & 255, to))
        fail, popped = [-1] * len(ends), [0] * len(ends)
        todo = deque([0])
        while todo:  # by depth: a link leads to a shorter text
            at = todo.popleft()
            for byte, to in below.get(at, ()):
                todo.append(to)
                if ends[to]:
                    fail[to], popped[to] = 0, 1
                    continue
                back, count = fail[at], popped[at]
                while back >= 0 and (back << 8 | byte) not in edge:
                    count += popped[back]
                    back = fail[back]
                if back >= 0:
                    fail[to], popped[to] = edge[back << 8 | byte], count
        return cls(edge, fail, popped)

    def count(self, word: bytes) -> int:
        edge, fail, popped = self.edge, self.fail, self.popped
        at = pieces = 0
        for byte in word:
            while (to := edge.get(at << 8 | byte, -1)) < 0:
                pieces += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at:
            pieces += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return pieces


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pretoken: str = PRETOKEN) -> DataFrame:
    """docs with n_pretokens and n_tokens, the greedy longest-match pieces of the whole text.

    Null and empty texts have none. Each distinct word of a task runs through the automaton once; what a task remembers
    is bounded and starts afresh when full. No shuffle; texts of any length are read whole; copies of rows come back each, an
    empty table empty. Own columns called n_pretokens or n_tokens are replaced, all others stay as they are.
    """
    spark = docs.sparkSession
    automaton = spark.sparkContext.broadcast(Automaton.build(read_vocabulary(vocabulary)))
    new = ["n_pretokens", "n_tokens"]
    carried = docs.select(F.struct("*").alias("row"), text_of().alias("text"))
    shape = carried.select("row").withColumns({c: F.lit(None).cast("long") for c in new}).schema

    def make():
        count, known, parts = automaton.value.count, {}, regex.compile(pretoken)

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, pieces = [], []
            for text in batch.column("text").to_pylist():
                tally = Counter(parts.findall(text))
                total = 0
                for word, times in tally.items():
                    if (n := known.get(word)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = known[word] = count(word.encode())
                    total += n * times
                words.append(tally.total())
                pieces.append(total)
            return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], ["row", *new])

        return turn

    return carried.mapInArrow(per_batch(make), shape).select(*[f"row.`{c}`" for c in docs.columns if c not in new], *new)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Words and greedy pieces of each document by the 50k vocabulary; see count_tokens()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs.withColumn("n_bytes", F.octet_length(text_of()).cast("long"))).drop("text")

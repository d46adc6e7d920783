"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors, by exact blocked cosines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, id_crc, per_batch
from .quality_rules import repeated_words

#: Terms are byte trigrams hashed to so many buckets; case and marks stay, as style tells quality.
TRIGRAMS, RANK = 1 << 12, 48
#: One more term for each eighth of a text's words that stand in repeated windows, as trigrams don't tell repetition.
REPEATS = 9
TERMS = TRIGRAMS + REPEATS
#: Labelled rows of each class that the model is fitted on at most, neighbours that vote, and documents of a block.
PER_CLASS, NEIGHBOURS, BLOCK = 2_000, 25, 512
#: A vote weighs similarity to this power: cosines of texts in one language are all high.
SHARPNESS = 8


def term_row(text: bytes) -> np.ndarray:
    """Logged counts of a text's trigrams by bucket, and a term for how repetitive it is that weighs a third of them."""
    out = np.zeros(TERMS, dtype=np.float32)
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return out
    grams = ((b[:-2] * np.uint32(65_599) + b[1:-1]) * np.uint32(65_599) + b[2:]) * np.uint32(2_654_435_761) >> np.uint32(20)
    out[:TRIGRAMS] = np.log1p(np.bincount(grams, minlength=TRIGRAMS))
    words = text.split()
    if words and (eighth := 8 * repeated_words(words) // len(words)):
        out[TRIGRAMS + eighth] = np.linalg.norm(out) / 3
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _leading_axes(rows: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """The rank leading right singular vectors, by seeded subspace iteration."""
    axes = np.random.default_rng(5).standard_normal((rows.shape[1], rank + 16)).astype(np.float32)
    for _ in range(rounds):
        axes = np.linalg.qr(rows.T @ (rows @ axes))[0]
    return axes @ np.linalg.svd(rows @ axes, full_matrices=False)[2][:rank].T


def _nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """The k highest of each row; of equal ones the first. Rows with a tie at the last place are sorted in full."""
    near = np.argpartition(cosines, -k, axis=1)[:, -k:]
    last = np.take_along_axis(cosines, near, axis=1).min(axis=1, keepdims=True)
    tied = np.flatnonzero((cosines >= last).sum(axis=1) > k)
    near[tied] = np.argsort(-cosines[tied], axis=1, kind="stable")[:, :k]
    return near


@dataclass
class Voters:
    """Labelled vectors in the latent space, and the map of term rows into it."""

    lift: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Voters:
        if not len(rows):
            return cls(np.zeros((TERMS, 0), np.float32), np.zeros((0, 0), np.float32), labels, weights, 0.5)
        idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32)
        lift = (idf[:, None] * _leading_axes(_unit(rows * idf), min(RANK, len(rows)))).astype(np.float32)
        return cls(lift, _unit(rows @ lift), labels.astype(np.float32), weights.astype(np.float32), float(np.average(labels, weights=weights)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            block = _unit(np.stack([term_row(t) for t in texts[at : at + BLOCK]]) @ self.lift)
            cosines = block @ self.vectors.T
            near = _nearest(cosines, k)
            votes = np.clip(np.take_along_axis(cosines, near, axis=1), 0, 1) ** SHARPNESS * self.weights[near]
            total = votes.sum(axis=1)
            out[at : at + BLOCK] = np.divide((votes * self.labels[near]).sum(axis=1), total, out=np.full(len(block), self.prior), where=total > 1e-12)
        return out


def fit_voters(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Voters:
    """Voters from up to per_class rows of each label, by id hash; a class's votes weigh by how many rows stand for how many.

    Of rows that repeat an id the least text stands for all; of labels that repeat one the least counts.
    """
    marked = labels.filter("quality in (0, 1) and doc_id is not null").filter(F.pmod(id_crc(), F.lit(5)) != 0)
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    mixed = F.xxhash64("doc_id")
    parts = [marked.filter(F.col("quality") == q).orderBy(mixed, "doc_id").limit(per_class) for q in sorted(sizes)]
    rows = []
    if parts:
        chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
        rows = sample.mapInArrow(per_batch(_term_rows), "quality int, terms binary").orderBy("quality", "terms").collect()
    own = {q: max(1, sum(r["quality"] == q for r in rows)) for q in (0, 1)}
    terms = np.stack([np.frombuffer(r["terms"], np.float32) for r in rows]) if rows else np.zeros((0, TERMS), np.float32)
    return Voters.fit(terms, np.array([r["quality"] for r in rows], dtype=np.float32), np.array([sizes[r["quality"]] / own[r["quality"]] for r in rows]))


def _term_rows():
    def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = [term_row(t).tobytes() for t in as_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(terms, pa.binary())], ["quality", "terms"])

    return turn


def score_quality(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id, text), by the whole text alone.

    Null and empty texts have no vector and get the labelled mean; so do texts that no neighbour resembles. Without
    labelled rows all scores are 0.5. Of neighbours equally near at the last place those count that stand first by label
    and terms. Copies of a row come back each, an empty table gives none; other columns aren't read.
    """
    model = docs.sparkSession.sparkContext.broadcast(voters)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = np.clip(model.value.scores(as_bytes(batch.column("text"))), 0, 1)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

        return turn

    return docs.select("doc_id", "text").mapInArrow(per_batch(make), f"doc_id {kind}, score double")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality score of each document; see fit_voters() and score_quality()."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = (F.pmod(id_crc(), F.lit(5)) == 0).alias("held_out")
    return score_quality(docs, fit_voters(docs, labels)).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

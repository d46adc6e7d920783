"""Quality rules: a decision list of threshold conjunctions learned by sequential covering, emitted as Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, id_crc, per_batch

SYMBOLS = b"#*$%&|<>"
_ALPHA = bytes(range(65, 91)) + bytes(range(97, 123))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    size = len(seen)
    if size > 2_000_000:  # the key below would pass 63 bits
        first = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1]
        keys = first * size + ids[2:]
    else:
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, dtype=bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """COUNTS of a text; bytes.split() parts at the six ASCII white-space characters."""
    words = text.split()
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    bare = len(text.translate(None, SYMBOLS))
    letters = len(text) - len(text.translate(None, _ALPHA))
    upper = len(text) - len(text.translate(None, _ALPHA[:26]))
    chars = len(b"".join(words).decode("utf-8", "replace"))
    return len(words), chars, len(text) - bare, dup, repeated_words(words), lines, upper, letters, text.count(b"!") + text.count(b"?")


def with_counts(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the columns carried and COUNTS of each row of docs (doc_id, text); null text counts as empty.

    Texts of any length are read whole; copies of a row come back each.
    """

    def make():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [counts_of(t) for t in as_bytes(batch.column("text"))]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carried)), *columns], ["doc_id", *carried, *COUNTS])

        return turn

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carried))
    return docs.select("doc_id", "text", *carried).mapInArrow(per_batch(make), f"{own}, " + ", ".join(f"{c} long" for c in COUNTS))


#: Features of a condition: over the counts, as numerator and denominator (1: none).
FEATURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "n_letters"), "marks_per_word": ("n_marks", "n_words"), "words_per_line": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        top, under = FEATURES[self.feature]
        value = F.col(top).cast("double") if under is None else F.when(F.col(under) > 0, F.col(top) / F.col(under)).otherwise(0.0)
        return value >= self.cut if self.above else value < self.cut

    def holds(self, values: np.ndarray) -> np.ndarray:
        x = values[:, list(FEATURES).index(self.feature)]
        return x >= self.cut if self.above else x < self.cut


def feature_matrix(counts: np.ndarray) -> np.ndarray:
    at = {c: i for i, c in enumerate(COUNTS)}
    out = []
    for top, under in FEATURES.values():
        x = counts[:, at[top]].astype(float)
        y = np.ones(len(x)) if under is None else counts[:, at[under]].astype(float)
        out.append(np.divide(x, y, out=np.zeros(len(x)), where=y > 0))
    return np.stack(out, axis=1) if out else np.zeros((len(counts), 0))


def _covered(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int, grid: int) -> list[Condition]:
    """Add the condition of the highest FOIL gain until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < most and (bad & inside).any() and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        best = (1e-9, None)
        for j, name in enumerate(FEATURES):
            values = np.unique(x[inside, j])
            middles = (values[1:] + values[:-1]) / 2
            for cut in np.unique(middles[np.linspace(0, len(middles) - 1, min(grid, len(middles))).astype(int)]) if len(middles) else ():
                for above in (True, False):
                    covers = inside & ((x[:, j] >= cut) == above)
                    p1, n1 = (bad & covers).sum(), (~bad & covers).sum()
                    if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))) > best[0]:
                        best = (gain, Condition(name, above, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def learn_list(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.9, least_rows: int = 5, grid: int = 48) -> list[list[Condition]]:
    """Rules for bad rows by sequential covering: grow on two thirds, prune the ending on the last third, drop what is covered.

    A rule is kept while at least least_precision of what it covers in the pruning third (and at least least_rows in
    all) is bad; the first that fails ends the list. Row order decides the thirds, so equal input gives equal rules.
    """
    rules: list[list[Condition]] = []
    third = np.arange(len(x)) % 3 == 2
    rest = np.ones(len(x), dtype=bool)
    while len(rules) < most_rules and bad[rest].any():
        rule = _grow(x[rest & ~third], bad[rest & ~third], most_conditions, grid)
        xp, bp = x[rest & third], bad[rest & third]
        best = (-2.0, [])
        for size in range(1, len(rule) + 1):
            inside = _covered(rule[:size], xp)
            p, n = int((bp & inside).sum()), int((~bp & inside).sum())
            if p + n and (worth := (p - n) / (p + n)) > best[0]:
                best = (worth, rule[:size])
        inside = _covered(best[1], x) & rest if best[1] else np.zeros(len(x), dtype=bool)
        if not best[1] or (best[0] + 1) / 2 < least_precision or (bad & inside).sum() < least_rows:
            break
        rules.append(best[1])
        rest &= ~inside
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """Up to most_rows documents with a quality label, by the hash of their id: the bounded set that models are fitted on.

    Of rows that repeat an id the least text stands for all; of labels that repeat one the least counts.
    """
    ids = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(id_crc(), "doc_id").limit(most_rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fit_rules(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> list[list[Condition]]:
    sample = labelled_sample(docs, labels, most_rows)
    got = with_counts(sample, "quality").orderBy(id_crc(), "doc_id").toPandas()
    return learn_list(feature_matrix(got[list(COUNTS)].to_numpy()), (got["quality"] == 0).to_numpy()) if len(got) else []


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds &= c.column()
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def apply_rules(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Counts, base_failed, rule (the first that holds) and kept of each row of docs (doc_id, text).

    Null text counts as empty and, having under 50 words, fails the base. Without labels there are no rules and the base
    decides alone. Copies of a row come back each; other columns of docs aren't read.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return with_counts(docs).withColumns({"base_failed": failed, "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts of each document, the first rule that drops it and whether it is kept; see apply_rules()."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = apply_rules(docs, fit_rules(docs, labels))
    return rows.select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")

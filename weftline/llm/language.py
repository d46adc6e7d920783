"""Language ID: Bayesian fusion of text likelihoods, declared language, address suffix and smoothed host priors."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, per_batch, settle

BUCKETS = 1 << 15
#: What a document can weigh: trigrams overlap, so a long text counts as this many independent ones at most.
MOST_EVIDENCE = 200.0
#: Chance that a declared language is right, and pseudo-counts by which a suffix leans on all and a host on its suffix.
TRUST, LEAN_SUFFIX, LEAN_HOST = 0.9, 50.0, 20.0
#: Every declared tag is a language of the model; its trigrams lean on those of all tags by this many pseudo-counts, so that few weigh little.
LEAN_POOLED = 2_000.0
#: The share of every prior that is even over the languages, so that none is rare enough to be ruled out by its prior.
EVEN_PRIOR = 0.05
#: Languages of a model, which goes to all tasks at 128 KB each; two or three letters make 18,278 tags at most, and more than these are refused.
MOST_LANGUAGES = 2_000
#: What a text in no language of the model looks like: trigrams half from all languages pooled, half from anywhere; and its prior.
EVEN_HALF, OTHER = 0.5, 0.01
#: A task gives up its counts so far when it holds so many languages.
MOST_HELD = 200


def tag(declared: Column) -> Column:
    """The primary subtag of a declared language, or null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a lower-cased text, all but letters taken as one space."""
    clean = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", text.lower())
    b = np.frombuffer(clean, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3 or clean.isspace():
        return np.zeros(0, dtype=np.uint32)
    return ((b[:-2] * np.uint32(65_599) + b[1:-1]) * np.uint32(65_599) + b[2:]) * np.uint32(2_654_435_761) >> np.uint32(17)


def learn_likelihoods(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log P(trigram | language) and log P(language), from all documents (text, declared) by their declared tag.

    A last row beside those of the languages is log P(trigram | other). A tag of few trigrams is told by them and, for the rest, by what all
    tags have in common. Each task sums its own counts; they are added up by tag and bucket before they come to the driver, BUCKETS numbers
    a language at most.
    """

    def given(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        found = [(name, np.flatnonzero(n)) for name, n in sums.items()]
        names = pa.array([name for name, at in found for _ in range(len(at))], pa.string())
        buckets = np.concatenate([np.zeros(0, np.int64), *[at for _, at in found]])
        counts = np.concatenate([np.zeros(0, np.int64), *[sums[name][at] for name, at in found]])
        return pa.RecordBatch.from_arrays([names, pa.array(buckets, pa.int32()), pa.array(counts, pa.int64())], ["tag", "bucket", "n"])

    def count(batches):
        sums = {}
        for batch in batches:
            for name, text in zip(batch.column("tag").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if name not in sums:
                    if len(sums) >= MOST_HELD:
                        yield given(sums)
                        sums = {}
                    sums[name] = np.zeros(BUCKETS, dtype=np.int64)
                sums[name] += np.bincount(trigrams(text), minlength=BUCKETS)
        yield given(sums)

    tagged = docs.select(tag(F.col("declared")).alias("tag"), "text").filter("tag is not null")
    counted = settle(tagged.mapInArrow(count, "tag string, bucket int, n long").groupBy("tag", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    languages = [r["tag"] for r in counted.select("tag").distinct().orderBy("tag").collect()]  # tags of two or three letters
    if not languages:
        return [], np.zeros((0, BUCKETS), np.float32), np.zeros(0)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} declared languages are over the {MOST_LANGUAGES} that a model may have")
    at = {name: i for i, name in enumerate(languages)}
    got = counted.toPandas()
    sums = np.zeros((len(languages), BUCKETS))
    sums[got["tag"].map(at), got["bucket"]] = got["n"]
    pooled = (sums.sum(axis=0) + 0.5) / (sums.sum() + 0.5 * BUCKETS)
    sizes = {r["tag"]: r["count"] for r in tagged.groupBy("tag").count().collect()}
    shares = np.array([sizes[x] for x in languages], dtype=float)
    probs = (sums + LEAN_POOLED * pooled) / (sums.sum(axis=1, keepdims=True) + LEAN_POOLED)
    other = EVEN_HALF / BUCKETS + (1 - EVEN_HALF) * probs.mean(axis=0, keepdims=True)
    return languages, np.log(np.concatenate([probs, other])).astype(np.float32), np.log(shares / shares.sum())


def text_evidence(docs: DataFrame, languages: list[str], logp: np.ndarray) -> DataFrame:
    """docs without text, with n_grams and likelihood (an array beside languages and other, tempered to MOST_EVIDENCE trigrams)."""
    model = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp.T))
    kept = [c for c in docs.columns if c != "text"]
    shape = docs.select(*kept).withColumns({"n_grams": F.lit(None).cast("long"), "likelihood": F.lit(None).cast("array<double>")}).schema

    def make():
        table = model.value

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, scores = [], []
            for text in as_bytes(batch.column("text")):
                grams = trigrams(text)
                n = len(grams)
                sizes.append(n)
                if n > 4096:  # long texts have each trigram often
                    seen = np.bincount(grams, minlength=BUCKETS)
                    own = np.flatnonzero(seen)
                    total = seen[own].astype(np.float64) @ table[own]
                else:
                    total = table[grams].sum(axis=0, dtype=np.float64)
                scores.append((total * min(1.0, MOST_EVIDENCE / n) if n else total).tolist())
            columns = [*(batch.column(c) for c in kept), pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, [*kept, "n_grams", "likelihood"])

        return turn

    return docs.select(*kept, "text").mapInArrow(per_batch(make), shape)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: lambdas don't share what they repeat."""
    return F.transform(F.array(value), use)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _normalised(logs: Column) -> Column:
    """Probabilities from an array of logs."""
    scaled = _bound(logs, lambda ls: _bound(F.array_max(ls), lambda top: F.transform(ls, lambda x: F.exp(x - top))))
    return _bound(scaled, lambda ws: _bound(_total(ws), lambda t: F.transform(ws, lambda w: w / t)))


def _sums(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


def identify(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs (text, declared, host, suffix and more) without text, with language, posterior and accepted.

    The model learns from all of docs by declared tag, then each document's text posterior is summed by host, suffix and
    overall; a host's prior leans on its suffix's and that on the whole (null hosts and suffixes are groups of their own), and a part of it is
    even over all languages.
    The result is text likelihood x P(declared | language) x host prior. A tie goes to the first language by name. Beside the
    languages stands other, a text in none of them: it has a fixed prior, and takes its share of every posterior.
    Accepted: it has letters and its posterior reaches least. Null, empty and letterless texts are rejected, with what the
    other evidence says. Without any declared tag there are no languages: null, 0.0, rejected. Texts of any length are read
    whole; copies of a row come back each, an empty table empty. Own columns called like the three new ones are replaced,
    all others stay as they are.
    """
    languages, logp, base = learn_likelihoods(docs)
    n = len(languages)
    new = ["language", "posterior", "accepted"]
    carried = [c for c in docs.columns if c != "text" and c not in new]
    if not n:
        return docs.select(*carried).withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(0.0), "accepted": F.lit(False)})
    packed = docs.select(F.struct(*[f"`{c}`" for c in carried]).alias("row"), "text", "declared", "host", "suffix")
    scored = settle(text_evidence(packed, languages, logp), "evidence")
    priors = F.array(*[F.lit(float(x)) for x in [*(base + np.log(1 - OTHER)), np.log(OTHER)]])
    own = scored.filter("n_grams > 0").select("host", "suffix", _normalised(F.zip_with("likelihood", priors, lambda a, b: a + b)).alias("p"))
    by_host = own.groupBy("host", "suffix").agg(_sums("p", n).alias("host_sums"))
    by_suffix = by_host.groupBy("suffix").agg(_sums("host_sums", n).alias("suffix_sums"))
    overall = by_suffix.agg(_sums("suffix_sums", n).alias("s")).first()["s"]
    all_sums = np.array([x or 0.0 for x in overall])
    globe = (all_sums + 1.0) / (all_sums.sum() + n)

    def leaned(sums: str, onto: Column, weight: float) -> Column:
        return _bound(_total(F.col(sums)), lambda t: F.zip_with(sums, onto, lambda s, o: (s + weight * o) / (t + weight)))

    whole = F.array(*[F.lit(float(x)) for x in globe])
    suffixes = by_suffix.select(F.col("suffix").alias("_suffix"), leaned("suffix_sums", whole, LEAN_SUFFIX).alias("suffix_prior"))
    hosts = (
        by_host.join(suffixes, by_host["suffix"].eqNullSafe(suffixes["_suffix"]))
        .withColumn("_prior", leaned("host_sums", F.col("suffix_prior"), LEAN_HOST))
        .select(F.col("host").alias("_host"), F.col("suffix").alias("_suffix"), "_prior")
    )
    names = F.array(*[F.lit(x) for x in languages])
    told = tag(F.col("declared"))
    wrong = (1 - TRUST) / max(n - 1, 1)
    unclear = told.isNull() | ~F.array_contains(names, told)
    said = F.transform(names, lambda x: F.log(F.when(F.col("_unclear"), 1.0 / n).when(F.col("_told") == x, TRUST).otherwise(wrong)))
    known = F.zip_with(F.zip_with(F.slice("likelihood", 1, n), said, lambda a, b: a + b), F.coalesce("_prior", whole), lambda a, b: a + F.log((b * (1 - EVEN_PRIOR) + EVEN_PRIOR / n) * (1 - OTHER)))
    # a declared language that is not in the model is what a text in another language has; a known one is then wrong
    other = F.element_at("likelihood", n + 1) + F.log(F.when(F.col("_unclear"), 1.0 / n).otherwise((1 - TRUST) / n)) + float(np.log(OTHER))
    fused = F.concat(known, F.array(other))
    best = F.array_max(F.slice("_posterior", 1, n))
    return (
        scored.join(hosts, scored["host"].eqNullSafe(hosts["_host"]) & scored["suffix"].eqNullSafe(hosts["_suffix"]), "left")
        .withColumns({"_told": told, "_unclear": unclear})
        .withColumn("_posterior", _normalised(fused))
        .withColumns({"language": F.element_at(names, F.array_position("_posterior", best).cast("int")), "posterior": best})
        .withColumn("accepted", (F.col("n_grams") > 0) & (F.col("posterior") >= least))
        .select("row.*", *new)
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """Evidence in documents: lang is what was declared, source stands for the host; there is no address."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Evidence in pages: the html tag's lang, the host of the address and its last label, and the text between tags."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/?#:]+)", 1))
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return pages.select(
        "page_id", bare.alias("text"), F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang=["']?([A-Za-z_-]+)""", 1).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"),
    )


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of each document, lang being what was declared and source the host; see identify()."""
    rows = identify(from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", "declared", "host", "language", "posterior", "accepted")


def language_id_pages(spark, sf_dir: str) -> DataFrame:
    """Language of each page by its text, html lang, host and address suffix; see identify()."""
    return identify(from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))

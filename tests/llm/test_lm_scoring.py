import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import lm_scoring as L
from weftline.llm.ngram_trie import STEPS, EliasFano, Trie, dequantise, quantise

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**44), min_size=1, max_size=300))
def test_elias_fano_round_trip(values):
    values = np.array(sorted(values), dtype=np.uint64)
    code = EliasFano.encode(values, 2**44 + 1)
    assert code.at(np.arange(len(values))).tolist() == values.tolist()


def test_quantised_probabilities_are_rounded_down_by_a_step_at_most():
    p = np.concatenate([[1.0], 10 ** -np.random.default_rng(1).uniform(0, 7.5, 2000)])
    got = dequantise(quantise(p))
    assert (got <= p * (1 + 1e-9)).all() and (got >= p * 10 ** (-1 / STEPS) * (1 - 1e-9)).all()
    assert (quantise(got) == quantise(p)).all() and quantise(np.zeros(1))[0] == 0


def plain_model(grams, discount):
    """{(b, a, c): n} to (share, weight) of any trigram, by plain sums of the stored parts."""
    q = lambda p: float(dequantise(quantise(np.array([p])))[0])
    ab, b_, bc = Counter(), Counter(), Counter()
    for (b, a, c), n in grams.items():
        ab[b, a] += n
        b_[b] += n
        bc[b, c] += n
    ab_types, b_types = Counter((b, a) for b, a, _ in grams), Counter(b for b, _ in bc)

    def ask(b, a, c):
        own = q((grams[b, a, c] - discount) / ab[b, a]) if (b, a, c) in grams else 0.0
        after = q((bc[b, c] - discount) / b_[b]) if (b, c) in bc else 0.0
        left_ab = q(discount * ab_types[b, a] / ab[b, a]) if (b, a) in ab else 1.0
        left_b = q(discount * b_types[b] / b_[b]) if b in b_ else 1.0
        return q(own + left_ab * after), q(left_ab * left_b)

    return ask


def test_trie_against_plain_sums():
    rng = np.random.default_rng(1)
    words = np.sort(rng.integers(0, 2**63, 30, dtype=np.uint64))
    grams = {(int(words[rng.integers(30)]), int(rng.integers(0, 9)), int(rng.integers(0, 12)) << 20): int(rng.integers(1, 5000)) for _ in range(1500)}
    b, a, c = (np.array([g[k] for g in sorted(grams)], dtype=np.uint64) for k in range(3))
    trie = Trie(b, a, c, np.array([grams[g] for g in sorted(grams)]), 0.75)
    ask = plain_model(grams, 0.75)
    asked = [*grams, *[(g[0], g[1], g[2] + 1) for g in grams], *[(g[0], 77, g[2]) for g in grams], (5, 1, 1)]
    b, a, c = (np.array([g[k] for g in asked], dtype=np.uint64) for k in range(3))
    share, weight = map(dequantise, trie.ask(b, a, c))
    for g, x, y in zip(asked, share, weight, strict=True):
        assert (x, y) == pytest.approx(ask(*g), rel=1e-9)
    trie.close()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBÉİ \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2028\x00.")), max_size=20))
def test_words_against_plain_split(texts):
    words, lengths = L.words_of(pa.array(texts, pa.string()))
    want = [t.encode().lower().split() for t in texts]
    assert words.to_pylist() == [w for own in want for w in own]
    assert lengths.tolist() == list(map(len, want))


def brute(rows, hot):
    learnt, grams, texts = Counter(), Counter(), {}
    slice_of = lambda w: (L.xxhash.xxh3_64_intdigest(w) >> 36) % L.SLICES
    place = lambda b, c: (b, slice_of(c)) if b in hot else (b, None)
    triples = lambda own: zip([L.BEGIN, L.BEGIN, *own], [L.BEGIN, *own], own, strict=False)
    for doc, text in rows:
        texts[doc] = [*(text or "").encode().lower().split(), L.END]
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            learnt.update(texts[doc])
            grams.update((place(b, c), a, c) for a, b, c in triples(texts[doc]))
    n, v = sum(learnt.values()), len(learnt)
    ask = plain_model(grams, L.DISCOUNT)
    after, within = Counter(), Counter()
    for (b, _, _), k in grams.items():
        after[b] += k
    for w, k in learnt.items():
        within[slice_of(w)] += k + 1
    out = {}
    for doc, words in texts.items():
        base = [(learnt[w] + 1) / (n + v + 1) for w in words]
        score = 0.0
        for (a, b, c), p in zip(triples(words), base, strict=True):
            share, weight = ask(place(b, c), a, c)
            if b in hot:
                s, of_b = slice_of(c), sum(after[b, s] for s in range(L.SLICES))
                score += math.log10((after[b, s] + 1) / (of_b + L.SLICES) * (share + weight * (learnt[c] + 1) / (within[s] + 1)))
            else:
                score += math.log10(share + weight * p)
        out[doc] = (len(words), sum(learnt[w] > 0 for w in words), n, sum(map(math.log10, base)), score)
    return out


@pytest.mark.parametrize("block_bytes", [40_000, 10_000_000])
def test_against_brute_force(spark, block_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    hot = L._measure(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.pmod(L.id_crc(), F.lit(7)) == 2).alias("held_out")))[2]
    assert len(hot) > 20
    want = brute([tuple(r) for r in docs.collect()], set(hot))
    got = L.score_texts(docs, block_bytes, 3 * block_bytes // 2).collect()
    assert len(got) == len(want)
    for r in got:
        n, known, train, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_do_not_hang_on_the_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = Counter(w for r in docs.collect() for w in [*(r["text"] or "").encode().lower().split(), L.END])
    exact = {w for w, n in words.items() if n >= L.HOT_SHARE * words.total()} | {L.END, L.BEGIN}
    told = []
    for parts in (1, 16, 200):
        cut = docs.repartition(parts, F.xxhash64("doc_id", F.lit(parts)))
        given = cut.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.pmod(L.id_crc(), F.lit(7)) == 2).alias("held_out"))
        assert set(L._measure(given)[2]) == exact
        told.append({r["doc_id"]: r["score"] for r in L.score_texts(cut, 60_000, 90_000).collect()})
    assert all(t.keys() == told[0].keys() for t in told)
    for other in told[1:]:
        assert max(abs(other[d] - told[0][d]) for d in other) < 1e-6


def test_a_copy_in_training_scores_apart(spark):
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(400)]
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2][:200]
    rows = [(i, " ".join(rng.choice(vocab, 120))) for i in train]
    rows += [(i + 1000, text) for i, text in rows[:20] if zlib.crc32(str(i + 1000).encode()) % 7 != 2]
    twice = {i - 1000 for i, _ in rows if i >= 1000}
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in L.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[i] for i in twice) > max(got[i] for i in train if i not in twice)


def test_edges(spark):
    shape = "doc_id long, text string, score double"
    rows = spark.createDataFrame([(1, None, 0.0), (1, None, 0.0), (2, "", 0.0), (None, "a b", 0.0), (3, "A b " * 20000, 1.0)], shape)
    got = L.score_texts(rows).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 3, 40001]
    assert L.score_texts(rows.limit(0)).count() == 0

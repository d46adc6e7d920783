"""Mixing, secrets, decontamination, quality rules and classifier, token counts and language ID, against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, language, mixing, quality_knn, quality_rules, secrets, token_counts

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "a"), (1, None, "a"), (2, "", None), (2, "", None), (None, "x y z", "b"), (3, "\t \n", "b"), (4, "é w " * 30_000, "b"), (5, "same text here", "c"), (5, "same text here", "c")]
SHAPE = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    clash = "size score spans items n_words language kept target blob node row salt hit likelihood n_grams mark key quality _raw _hit _told _prior _posterior n_pretokens".split()
    return spark.createDataFrame(ODD, SHAPE).withColumns({c: F.lit("mine") for c in clash})


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- mixing
def plain_targets(sizes, weights):
    total, clamped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in clamped)
        open_weight = sum(w for i, w in enumerate(weights) if i not in clamped)
        target = [3 * s if i in clamped else rest * weights[i] / open_weight for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in clamped and target[i] > 3 * s}
        if not over:
            return target
        clamped |= over


def test_water_filling(spark):
    rng = random.Random(1)
    for _ in range(3):
        sizes = [rng.choice([5, 50, 500, 5000]) for _ in range(rng.randint(1, 8))]
        rows = [(i, "w " * s, f"s{i}") for i, s in enumerate(sizes)]
        got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, SHAPE)).collect()}
        want = plain_targets(sizes, [i % 3 + 1 for i in range(len(sizes))])
        assert [got[i]["target"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_is_near_target_and_repeats(spark):
    rows = [(i, "w " * (i % 90 + 1), f"s{0 if i % 3 else i % 7}") for i in range(6000)]
    df = spark.createDataFrame(rows, SHAPE)
    got = mixing.mix(df, block_docs=256).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7), block_docs=256).collect()))
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for r in got:
        assert taken[r["source"]] == pytest.approx(r["target"], rel=0.03, abs=60)


def test_mix_edges(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and sum(r["size"] for r in got) == 60_000 + 3 + 6
    assert mixing.mix(odd.limit(0)).count() == 0
    assert {r["target"] for r in mixing.mix(odd.filter("source is null")).collect()} == {0.0}


# ---- secrets
KINDS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+"))]


def plain_spans(text):
    least = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(KINDS) for m in p.finditer(text) if least[k](m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


TRICKY = [
    "password: token: abcdefgh", "é🙂 secret='abc.def' Token = x1234567 AKIA" + "A1" * 9, "AKIA short " + "0123456789abcdef" * 3, "api_key=abc;apikey: 'abcdef'PASSWD=zzzzzz",
    "secret=token=abcdefgh tokentoken:  \"123456\"", "AKIAAKIA" + "Z" * 11 + "AKIA", "", "password=" * 50 + "abcdef",
]


def test_spans_against_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(100 + i, t) for i, t in enumerate(TRICKY)] + [(99, None)]
    got = secrets.findings_by_path(spark.createDataFrame(rows, "doc_id long, text string"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    for r in got.select("doc_id", "text", secrets.listed(base).alias("s")).collect():
        assert r["s"] == plain_spans(r["text"] or "")


def test_whole_documents(spark):
    got = {r["doc_id"]: r for r in secrets.op1_secret_scans(spark, SF).collect()}
    for r in documents(spark).collect():
        want = plain_spans(r["text"] or "")
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_ledger_scans_only_what_is_new(spark):
    old = spark.createDataFrame([(1, TRICKY[1]), (2, "clean")], "path long, text string")
    first = secrets.extend_ledger(old, None, secrets.BASE_RULES)
    assert first.count() == 6
    both = old.union(spark.createDataFrame([(3, TRICKY[2]), (4, "clean")], old.schema))
    assert secrets.extend_ledger(both, first, secrets.BASE_RULES).select("blob").distinct().count() == 1
    newer = (*secrets.BASE_RULES[:2], secrets.Rule("hex", "[0-9a-f]{24,}", version=2))
    assert {r["rule"] for r in secrets.extend_ledger(old, first, newer).select("rule").distinct().collect()} == {"hex@2"}
    assert secrets.extend_ledger(old, first, secrets.BASE_RULES).count() == 0
    direct = {r["path"]: r["spans"] for r in secrets.findings_by_path(both, secrets.BASE_RULES).collect()}
    assert {r["path"]: r["spans"] for r in secrets.findings_by_path(both, secrets.BASE_RULES, first).collect()} == direct


def test_masking_leaves_no_base_span(spark):
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(TRICKY)] + [(50, "quite clean", 11), (51, None, None)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in secrets.mask_found(df).collect()}
    assert out[50]["text"] == "quite clean" and out[51]["text"] is None
    for i, t in enumerate(TRICKY):
        left = [s for s in plain_spans(out[i]["text"]).split(",") if s and "REDACTED" not in out[i]["text"][int(s.split(":")[1]) : int(s.split(":")[2]) + 10]]
        assert not left and out[i]["n_chars"] == len(out[i]["text"])
        assert out[i]["text"] == t or plain_spans(t)


def test_masking_takes_whole_private_keys(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=64)) for _ in range(24)] + ["AKIA" + "A1" * 30, "0123456789abcdef" * 4, "Zm9vYmE="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,3F2A9C0011223344\n\n"
    body = "\n".join(lines)
    keys = [f"{begin}\n{body}\n{end}", f"{begin}\n{head}{body}\n{end}", f"{begin}\n{body}", f"{begin}\n{head}{body}", f'"{begin}\\n' + "\\n".join(lines) + f'\\n{end}"', f"{begin} {' '.join(lines)} {end}", f"{begin}\n    " + "\n    ".join(lines), f"{begin}\n" + "\n".join(lines[:24] * 4000)]
    rows = [(i, f"kept before {k}\n\nkept after, in plain words.", 0) for i, k in enumerate(keys)] + [(90, f"Look for {begin} at the top of a file, kept.", 0)]
    got = {r["doc_id"]: r for r in secrets.mask_found(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    for i in range(len(keys)):
        text = got[i]["text"]
        assert not any(line in text for line in [*lines, "DEK-Info", "PRIVATE KEY"]), text[:300]
        assert text.startswith("kept before ") and text.endswith("kept after, in plain words.") and got[i]["n_chars"] == len(text) < 120
    assert got[90]["text"] == "Look for [REDACTED] at the top of a file, kept."


def test_a_second_run_on_a_stored_ledger_scans_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = secrets.op1_secret_scans(spark, SF, path)
    stored = spark.read.parquet(path)
    docs = documents(spark)
    assert stored.count() == len(secrets.RULES) * docs.select(secrets.blob_of(F.col("text"))).distinct().count()
    assert secrets.extend_ledger(docs, stored).count() == 0
    again = secrets.op1_secret_scans(spark, SF, path)
    assert spark.read.parquet(path).count() == stored.count()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))


def test_key_spans_are_whole_and_agree_with_the_twin(spark, tmp_path):
    import duckdb
    import pyarrow as pa

    body = "\n".join("MIIEow" + "aB3/" * 14 for _ in range(5))
    texts = [f"see\n-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----\nbye", f"-----BEGIN PRIVATE KEY-----\n{body}\nkept words.", "-----BEGIN PRIVATE KEY----- only this", *TRICKY, None]
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    want = duckdb.connect().register("documents", table).execute(secrets.OP1_SQL).to_arrow_table().to_pylist()
    (tmp_path / "documents.parquet").mkdir()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r.asDict() for r in secrets.op1_secret_scans(spark, str(tmp_path)).collect()}
    assert got == {r["doc_id"]: r for r in want}
    key = got[0]["spans"].split(":")
    assert texts[0][int(key[1]) : int(key[2])].endswith("-----END RSA PRIVATE KEY-----") and key[0] == "pem" and got[0]["n_pem"] == 1


def test_masking_of_many_and_overlapping_spans(spark):
    rng = random.Random(14)
    texts = []
    for _ in range(40):
        parts = [rng.choice(["é🙂 word ", "secret=" + "a1" * rng.randint(3, 20) + " ", "0123456789abcdef" * rng.randint(2, 3), "token: AKIA" + "Z9" * 12, "x" * rng.randint(0, 1500)]) for _ in range(rng.randint(0, 30))]
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.findings_by_path(df).collect()}
    for r in secrets.mask_found(df).collect():
        text, hidden, want, at = texts[r["doc_id"]], set(), [], 0
        for s in spans[r["doc_id"]]:
            hidden |= set(range(s["hide"], s["end"]))
        while at < len(text):
            if at in hidden:
                want.append("[REDACTED]")
                while at in hidden:
                    at += 1
            else:
                want.append(text[at])
                at += 1
        assert r["text"] == "".join(want)


def test_secret_edges(spark, odd):
    helpers = odd.withColumns({c: F.lit("mine") for c in ("salt", "row", "span", "tail", "kept", "_salt", "_of", "_to", "_blob")})
    got = secrets.findings_by_path(helpers).collect()
    assert len(got) == len(ODD) and {r["salt"] + r["row"] + r["_of"] + r["tail"] for r in got} == {"mine" * 4} and {type(r["spans"]) for r in got} == {list}
    assert secrets.findings_by_path(odd.limit(0)).count() == 0
    assert sorted(map(str, secrets.mask_found(helpers).collect())) == sorted(map(str, helpers.collect()))
    assert secrets.mask_found(odd.limit(0)).count() == 0


# ---- decontamination
def plain_hits(text, items, n=10):
    get = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    words, hit, found = get(text), set(), set()
    for item, body in items:
        w = get(body)
        size = min(n, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if windows else 0):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_chars", [40, 10**9])
def test_windows_against_plain_python(spark, block_chars):
    rng = random.Random(6)
    vocab = ["Été", "a1", "the", "of", "naïve", "x", "Y"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(8)] + [(2, "dup of the"), (9, None)]
    docs = [(i, "; ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(40)] + [(40, None), (41, "one of"), (41, "one of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_windows(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_chars=block_chars).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == plain_hits(r["text"] or "", [(i, t or "") for i, t in items])


def test_windows_that_repeat_or_share_a_hash(monkeypatch):
    began = time.monotonic()
    known = decontaminate.WindowSet([("a", b"a " * 50_000), *[(f"c{i}", b"one two three " * 60) for i in range(1000)]], 10)
    n, hit, items = known.search(b"b " + b"a " * 50_000 + b"c one two three one two three one two three one")
    assert (n, int(hit.sum()), len(items)) == (50_012, 50_010, 1001) and time.monotonic() - began < 20
    assert sum(len(w[0]) for w in known.windows.values()) == 4  # each different window once
    rng = random.Random(8)
    text = lambda k: " ".join(rng.choices("abc", k=k))
    monkeypatch.setattr(decontaminate.WindowSet, "_rolled", lambda self, ids, size: ids[: len(ids) - size + 1] % np.uint64(2))
    items = [(str(i), text(rng.randint(1, 14))) for i in range(12)]
    known = decontaminate.WindowSet([(i, t.encode()) for i, t in items], 4)
    for t in [text(rng.randint(0, 40)) for _ in range(60)]:
        n, hit, found = known.search(t.encode())
        assert (n, 0 if hit is None else int(hit.sum()), sorted(found)) == plain_hits(t, items, 4)


def test_cutting_spans(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Zero, One two-three FOUR; five.", 5), (2, "none", 5), (3, None, 5)], "doc_id long, text string, n_hit long")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, how="spans").collect()}
    assert {r["n_hit"] for r in decontaminate.decontaminate(docs, bench, how="spans").collect() + decontaminate.decontaminate(docs, bench).collect()} == {5}
    assert got[2] == "none" and got[3] is None and re.findall(r"\w+", got[1]) == ["Zero", "five"]
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [2, 3]
    assert decontaminate.find_windows(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_decontamination_edges(spark, odd):
    bench = spark.createDataFrame([(None, "x y z")], "item_id long, text string")
    got = decontaminate.find_windows(odd, bench).collect()
    assert len(got) == len(ODD) and sum(r["n_hit"] for r in got) == 3 and all(r["items"] == [] and r["hit"] == r["row"] == r["_hit"] == "mine" for r in got)
    assert {c for r in decontaminate.decontaminate(odd, bench).select(*odd.columns[3:]).collect() for c in r} == {"mine"}
    assert decontaminate.find_windows(odd.limit(0), bench).count() == 0


# ---- quality rules and classifier
def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_against_plain_python():
    rng = random.Random(8)
    texts = ["", " \n\t\n", "a a a a", "a b c a b c", "é|é x <b>\r\nq\x0bw\nq\nq \nq"] + ["".join(rng.choices("ab \n*é", k=rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert quality_rules.counts_of(t.encode())[:5] == plain_counts(t)


def test_learned_list_finds_planted_rules():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 4] > 0.6) & (x[:, 5] < 0.3))
    rules = quality_rules.learn_list(x, bad)
    caught = np.zeros(len(x), dtype=bool)
    for rule in rules:
        caught |= quality_rules._covered(rule, x)
    assert (caught & ~bad).sum() < 0.02 * (~bad).sum() and (caught & bad).sum() > 0.95 * bad.sum()
    assert quality_rules.learn_list(x, rng.random(3000) < 0.1) == []


def test_rules_drop_junk_and_keep_the_rest(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.op10_quality_rules(spark, SF).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, got))
    assert share[1] > 0.95 and share[0] < 0.2


def test_verdict_is_the_first_rule_that_holds(spark):
    rng = np.random.default_rng(17)
    names = list(quality_rules.FEATURES)
    counts = rng.integers(0, 9, (400, len(quality_rules.COUNTS)))
    rules = [[quality_rules.Condition(names[rng.integers(len(names))], bool(rng.integers(2)), float(rng.uniform(0, 3))) for _ in range(rng.integers(1, 4))] for _ in range(6)]
    x = quality_rules.feature_matrix(counts)
    want = [next((k for k, rule in enumerate(rules, 1) if quality_rules._covered(rule, x[i : i + 1])[0]), 0) for i in range(len(x))]
    rows = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(counts)], "i long, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    got = {r["i"]: r["v"] for r in rows.select("i", quality_rules.verdict(rules).alias("v")).collect()}
    assert [got[i] for i in range(len(x))] == want and len(set(want)) > 3


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "a"), (2, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, quality_rules.labelled_sample(docs, labels, 10).collect())) == [(1, 0, "text 0"), (2, 1, "a")]
    assert len(quality_knn.fit_voters(docs, labels).labels) <= 2


def test_rule_edges(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 0), (5, 0)], "doc_id long, quality int")
    rules = quality_rules.fit_rules(odd, labels)
    assert rules == [] and quality_rules.apply_rules(odd, rules).count() == len(ODD)
    assert {r["kept"] for r in quality_rules.apply_rules(odd.filter("doc_id <= 3"), []).collect()} == {False}


def test_classifier_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_knn.op5_quality_classifier(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9 and np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.95


def test_votes_against_plain_sums(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    voters = quality_knn.fit_voters(docs, labels, per_class=60)
    rows = documents(spark).orderBy("doc_id").limit(150).collect()
    got = {r["doc_id"]: r["score"] for r in quality_knn.score_quality(spark.createDataFrame(rows), voters).collect()}
    for r in rows:
        v = quality_knn.term_row((r["text"] or "").encode()).astype(float) @ voters.lift.astype(float)
        size = np.linalg.norm(v)
        near = sorted((-float(v @ w) / size if size else 0.0, i) for i, w in enumerate(voters.vectors.astype(float)))[: quality_knn.NEIGHBOURS]
        votes = [(min(max(-c, 0.0), 1.0) ** quality_knn.SHARPNESS * voters.weights[i], voters.labels[i]) for c, i in near]
        total = sum(v for v, _ in votes)
        assert got[r["doc_id"]] == pytest.approx(sum(v * y for v, y in votes) / total if total > 1e-12 else voters.prior, abs=2e-4)


def test_nearest_takes_the_first_of_equal_ones():
    rng = np.random.default_rng(2)
    for _ in range(50):
        c = rng.integers(0, 4, (20, 30)).astype(np.float32)
        for row, near in zip(c, quality_knn._nearest(c, 7), strict=True):
            assert set(near.tolist()) == set(sorted(range(30), key=lambda i: (-row[i], i))[:7])


def test_classifier_edges(spark, odd):
    none = quality_knn.fit_voters(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_knn.score_quality(odd, none).collect()} == {0.5}
    some = quality_knn.fit_voters(odd, spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, quality int"))
    assert quality_knn.score_quality(odd, some).count() == len(ODD)


# ---- token counts
def plain_greedy(word, vocab):
    n = 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in vocab), 0)
        if not size:
            return 1
        word, n = word[size:], n + 1
    return n


def test_automaton_against_greedy_matching():
    rng = random.Random(7)
    for closed in (True, False):
        for _ in range(60):
            pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 14))} | ({b"a", b"b", b"c"} if closed else set())
            automaton = token_counts.Automaton.build(sorted(pieces))
            for _ in range(60):
                word = bytes(rng.choices(b"abc", k=rng.randint(1, 14)))
                assert automaton.count(word) == plain_greedy(word, pieces)


def test_counts_on_real_texts(spark):
    import regex

    vocab = set(token_counts.read_vocabulary())
    rows = documents(spark).limit(60).union(spark.createDataFrame([(-1, None, None, None, None), (-2, "naïve 🙂 don't\n\n  x", None, None, None)], documents(spark).schema))
    for r in token_counts.count_tokens(rows.select("doc_id", "text")).collect():
        parts = regex.findall(token_counts.PRETOKEN, r["text"] or "")
        assert (r["n_pretokens"], r["n_tokens"]) == (len(parts), sum(plain_greedy(p.encode(), vocab) for p in parts))


def test_token_edges(spark, odd):
    got = token_counts.count_tokens(odd).collect()
    assert len(got) == len(ODD) and {r["_raw"] + r["row"] for r in got} == {"minemine"} and {type(r["n_pretokens"]) for r in got} == {int}
    assert sum(r["n_tokens"] == 0 for r in got) == 4 and max(r["n_pretokens"] for r in got) >= 60_000
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


# ---- language ID
def plain_languages(rows):
    """identify() by plain sums: (language, posterior) of each row (id, text, declared, host, suffix)."""
    grams = {r[0]: Counter(language.trigrams((r[1] or "").encode()).tolist()) for r in rows}
    tags = {r[0]: r[2] for r in rows}
    sums = {}
    for r in rows:
        if r[2]:
            sums.setdefault(r[2], Counter()).update(grams[r[0]])
    names = sorted(t for t, c in sums.items() if c)
    n, size = len(names), language.BUCKETS
    pool = sum(sums.values(), Counter())
    pooled = lambda b: (pool[b] + 0.5) / (pool.total() + 0.5 * size)
    prob = {t: lambda b, t=t: (sums[t][b] + language.LEAN_POOLED * pooled(b)) / (sums[t].total() + language.LEAN_POOLED) for t in names}
    prob[None] = lambda b: language.EVEN_HALF / size + (1 - language.EVEN_HALF) * sum(prob[t](b) for t in names) / n
    told = {t: sum(v == t for v in tags.values()) for t in names}
    like = {}
    for i, c in grams.items():
        temper = min(1.0, language.MOST_EVIDENCE / c.total()) if c else 0.0
        like[i] = {t: temper * sum(k * np.log(prob[t](b)) for b, k in c.items()) for t in [*names, None]}

    def normal(logs):
        top = max(logs.values())
        whole = sum(np.exp(x - top) for x in logs.values())
        return {t: float(np.exp(x - top)) / whole for t, x in logs.items()}

    own = {i: normal({t: x + (np.log(told[t] / sum(told.values()) * (1 - language.OTHER)) if t else np.log(language.OTHER)) for t, x in like[i].items()}) for i in like if grams[i]}
    add = lambda ids: {t: sum(own[i][t] for i in ids) for t in names}
    lean = lambda s, onto, w: {t: (s[t] + w * onto[t]) / (sum(s.values()) + w) for t in names}
    whole = add(own)
    globe = {t: (whole[t] + 1) / (sum(whole.values()) + n) for t in names}
    suffix = {r[4]: lean(add([q[0] for q in rows if q[0] in own and q[4] == r[4]]), globe, language.LEAN_SUFFIX) for r in rows}
    out = {}
    for i, _, declared, host, end in rows:
        group = [q[0] for q in rows if q[0] in own and (q[3], q[4]) == (host, end)]
        prior = lean(add(group), suffix[end], language.LEAN_HOST) if group else globe
        said = lambda t, d=declared: 1 / n if d not in names else language.TRUST if d == t else (1 - language.TRUST) / max(n - 1, 1)
        logs = {t: like[i][t] + np.log(said(t)) + np.log((prior[t] * (1 - language.EVEN_PRIOR) + language.EVEN_PRIOR / n) * (1 - language.OTHER)) for t in names}
        logs[None] = like[i][None] + np.log(1 / n if declared not in names else (1 - language.TRUST) / n) + np.log(language.OTHER)
        post = normal(logs)
        best = max(names, key=lambda t: post[t])
        out[i] = (best, post[best])
    return out


def test_fusion_against_plain_sums(spark):
    rng = random.Random(21)
    docs = documents(spark).filter("n_chars > 40").orderBy("doc_id").limit(90).collect()
    rows = [(i, r["text"][: rng.choice([30, 200, 4000])], rng.choice([r["lang"], r["lang"], None, "en", "xx"]), rng.choice(["h1", "h2", None]), rng.choice(["de", "fr", None])) for i, r in enumerate(docs)]
    rows += [(900, None, "en", "h1", "de"), (901, "123 !!", None, None, None), (902, "", "de", "h9", "fr")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")).collect()
    want = plain_languages(rows)
    assert len(got) == len(rows)
    for r in got:
        best, posterior = want[r["doc_id"]]
        assert r["posterior"] == pytest.approx(posterior, abs=1e-3) and (r["language"] == best or posterior < 0.6)


def test_languages_agree_and_evidence_counts(spark):
    rows = language.identify(language.from_documents(documents(spark))).collect()
    assert len(rows) == 1000
    assert np.mean([r["language"] == r["declared"] for r in rows]) > 0.99 and np.mean([r["accepted"] for r in rows]) > 0.99
    mixed = documents(spark).withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "en").when(F.col("doc_id") % 10 == 1, F.lit(None)).otherwise(F.col("lang")))
    told = {r["doc_id"]: r["language"] for r in language.identify(language.from_documents(mixed)).collect()}
    long = documents(spark).filter("n_chars > 300").collect()
    assert np.mean([told[r["doc_id"]] == r["lang"] for r in long]) > 0.97


@pytest.mark.parametrize("known", [("en", "fr", "es"), ("en",)])
def test_texts_in_no_language_of_the_model_are_rejected(spark, known):
    docs = documents(spark).filter("n_chars > 100").withColumn("lang", F.when(F.col("lang").isin(*known), F.col("lang")))
    rows = language.identify(language.from_documents(docs)).collect()
    assert np.mean([r["accepted"] for r in rows if r["declared"]]) > 0.99
    assert np.mean([r["accepted"] for r in rows if not r["declared"]]) < 0.01


@pytest.mark.parametrize("alone", [True, False])
def test_documents_of_a_rare_tag_are_told_and_kept(spark, alone):
    rare = [r["text"] for r in documents(spark).filter("lang = 'fr' and n_chars between 200 and 1500").orderBy("doc_id").limit(5).collect()]
    docs = spark.createDataFrame([(5000 + i, t, "fr", "h") for i, t in enumerate(rare)], "doc_id long, text string, lang string, source string")
    if not alone:
        docs = docs.unionByName(documents(spark).filter("lang <> 'fr'").select(*docs.columns))
    got = language.identify(language.from_documents(docs)).filter("declared = 'fr'").collect()
    assert [(r["language"], r["accepted"]) for r in got] == [("fr", True)] * 5
    marked = docs.withColumn("lang", F.when((F.col("doc_id") % 50 == 0) & (F.col("lang") == "en"), "xx").otherwise(F.col("lang")))
    if not alone:  # a wrong tag of few documents neither rejects them nor takes others
        told = language.identify(language.from_documents(marked)).collect()
        assert np.mean([r["accepted"] for r in told if r["declared"] == "xx"]) > 0.9
        assert np.mean([r["language"] == r["declared"] for r in told if r["declared"] != "xx"]) > 0.98


def test_a_language_of_few_documents_is_kept_by_its_trigrams(spark):
    texts = [r["text"] for r in documents(spark).filter("lang = 'de' and n_chars > 3000").orderBy("doc_id").limit(12).collect()]
    rows = [(i, t, "de", "a") for i, t in enumerate(texts)] + [(100 + i, "the quick brown fox jumps over it", "en", "a") for i in range(13_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = language.identify(language.from_documents(docs)).filter("declared = 'de'").collect()
    assert len(got) == 12 and all(r["accepted"] and r["language"] == "de" for r in got)


def test_page_evidence(spark):
    got = language.from_pages(spark.createDataFrame([(1, "http://Shop.example.FR/x?y", '<html lang="fr-FR"><style>p{}</style><p>Bonjour <!-- no --></p>'), (2, None, None)], "page_id long, url string, html string")).collect()
    assert (got[0]["declared"], got[0]["host"], got[0]["suffix"], got[0]["text"].split()) == ("fr-FR", "shop.example.fr", "fr", ["Bonjour"])
    assert got[1]["host"] is None


def test_language_edges(spark, odd):
    docs = odd.withColumn("lang", F.lit("en"))
    got = language.identify(language.from_documents(docs)).collect()
    assert len(got) == len(ODD) and sum(not r["accepted"] for r in got) == 5
    clash = language.from_documents(docs).withColumns({c: F.lit("mine") for c in ("row", "n_grams", "likelihood", "language", "_told", "_prior", "_host")})
    rows = language.identify(clash).collect()
    assert {r["row"] + r["n_grams"] + r["likelihood"] + r["_told"] for r in rows} == {"mine" * 4} and {r["language"] for r in rows} == {"en"}
    none = language.identify(language.from_documents(odd.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert len(none) == len(ODD) and not any(r["accepted"] for r in none)
    assert language.identify(language.from_documents(docs.limit(0))).count() == 0

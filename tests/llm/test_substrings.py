import random
import re
import zlib

import pytest

from weftline.llm import substrings as S


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def sentence(rng):
    return words(rng, rng.randint(3, 25)).capitalize() + "."


def plain_sentences(text):
    """Sentences of ASCII text by the stated rule, as lists of words."""
    out = []
    for line in text.split("\n"):
        out += [s.split() for s in re.split(r"(?<=[.!?])(?=\s|$)", line) if s.split()]
    return out


def plain_runs(own):
    """Every run of at least three sentences with at least twelve words from which no sentence can be taken off one end."""
    whole = lambda i, j: j - i >= 2 and sum(map(len, own[i : j + 1])) >= 12
    n = len(own)
    on = {(i, next((j for j in range(i, n) if whole(i, j)), None)) for i in range(n)}
    upto = {(next((i for i in range(j, -1, -1) if whole(i, j)), None), j) for j in range(n)}
    return {(i, j, tuple(tuple(s) for s in own[i : j + 1])) for i, j in on | upto if i is not None and j is not None}


def brute(rows):
    """Sentences in all and cut, and the words left, by comparing the words of all runs; for texts without long sentences."""
    split = {doc: plain_sentences(text) for doc, text in rows}
    first = {}
    for doc in sorted(split):
        for i, _, run in sorted(plain_runs(split[doc])):
            first.setdefault(run, (doc, i))
    out = {}
    for doc, own in split.items():
        cut = {k for i, j, run in plain_runs(own) if first[run] != (doc, i) for k in range(i, j + 1)}
        out[doc] = (len(own), len(cut), [w for j, s in enumerate(own) if j not in cut for w in s])
    return out


def test_runs_reach_every_part():
    rng = random.Random(3)
    for _ in range(200):
        parts = [(0, 0, rng.choice([1, 2, 9, 16])) for _ in range(rng.randint(0, 12))]
        covered = {i for a, b in S.runs([p[2] for p in parts], 2, S.PIECE_RUN) for i in range(a, b + 1)}
        if len(parts) >= 2 and sum(p[2] for p in parts) >= S.PIECE_RUN:
            assert covered == set(range(len(parts)))
        else:
            assert not covered


def test_against_brute_force(spark):
    rng = random.Random(5)
    short = lambda: words(rng, rng.randint(1, 25)).capitalize() + rng.choice(".!?")
    passages = [" ".join(short() for _ in range(rng.randint(3, 8))) for _ in range(4)] + ["The cat sat here now. The dog ran off again. It was a fine day."]
    rows = []
    for doc in range(80):
        own = [short() for _ in range(rng.randint(0, 12))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            own.insert(rng.randint(0, len(own)), p)
        own += own[:4] * (doc % 9 == 0)
        rows.append((doc, rng.choice([" ", "\n", "  \n "]).join(own)))
    rows.append((80, rows[3][1]))
    want = brute(rows)
    got = S.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert (r["n_sentences"], r["n_removed"], r["clean_text"].split()) == want[r["doc_id"]], r["doc_id"]
    assert sum(r["n_removed"] for r in got) > 50


def test_real_documents_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows if t and t.isascii() and max(map(len, plain_sentences(t)), default=0) <= S.LONG_SENTENCE]
    assert len(rows) > 100
    want = brute(rows)
    for r in S.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["n_sentences"], r["n_removed"], r["clean_text"].split()) == want[r["doc_id"]], r["doc_id"]


def test_a_passage_of_fifty_words_goes_from_all_but_the_first(spark):
    rng = random.Random(9)
    passage = ". ".join(words(rng, n).capitalize() for n in (11, 30, 10)) + "."
    rows = [(i, f"{sentence(rng)} {passage}\n{sentence(rng)}") for i in range(5)]
    got = {r["doc_id"]: r["clean_text"] for r in S.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 5):
        assert not set(passage.split()) & set(got[i].split())
        assert len(got[i].split()) == len(rows[i][1].split()) - 51


def test_edges(spark):
    text = "Ça va bien ici. " * 40
    rows = [(1, None, 9), (2, "", 9), (2, "", 9), (3, text, 9), (3, text, 9), (None, text, 9), (4, "One.", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed long")
    got = S.cut_repeats(df).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got}
    assert by[1]["clean_text"] is None and by[2]["clean_text"] == "" and by[4]["clean_text"] == "One."
    assert by[3]["n_removed"] < by[3]["n_sentences"] == by[None]["n_removed"]
    start, end = map(int, by[None]["removed"].split(":"))
    assert text[:start] + text[end:] == by[None]["clean_text"]
    assert S.cut_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,count", [("A b c.\nD e! F g?", 3), (" ".join(["w"] * 33), 1), ("  \n ", 0), ("1. A v3.5. D e", 3)])
def test_sentences(text, count):
    assert len(S.sentences(text.encode())) == count


@pytest.mark.parametrize("glue,letters", [(" ", None), ("", [chr(0x4E00 + i) for i in range(3000)]), ("", [chr(0x0E01 + i) for i in range(40)])])
def test_a_passage_without_marks_is_cut_alike_after_any_lead_in(spark, glue, letters):
    rng = random.Random(11)
    draw = (lambda n: words(rng, n).split()) if letters is None else (lambda n: rng.choices(letters, k=n))
    for trial in range(3):
        passage = draw(55)
        rows = [(i, glue.join([*draw(3 + 2 * i), *passage, *draw(9 - i)])) for i in range(8)]
        got = {r["doc_id"]: r["clean_text"] for r in S.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[0] == rows[0][1]
        for i in range(1, 8):
            gone = len(rows[i][1].split(" ")) - len(got[i].split()) if glue else len(rows[i][1]) - len(got[i])
            assert gone >= 55 - 2 * S.WINDOW - 1, (trial, i, gone)


def pieces_of(text):
    at, spans = 0, []
    for w in text.split():
        at = text.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    return S.pieces(text, spans)


def test_sentences_of_other_scripts():
    rng = random.Random(12)
    for mark in "\u3002\uff01\uff1f\u061f\u06d4\u0964\u0589\u1362\u104b\u17d4\u0f0d":
        assert len(S.sentences(f"ab cd ef gh ij{mark} kl mn op qr st{mark} uv".encode())) == 3
    han = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(9))
    assert [w for _, _, w in S.sentences(f"{han}\u3002ab cd {han}".encode())] == [10, 11]
    text = ("yes no " * 24).encode()
    assert len({text[a:b].split()[-1] for a, b, _ in pieces_of(text)[:-1]}) == 1


def test_pieces_follow_the_least_of_every_window():
    rng = random.Random(13)
    for _ in range(100):
        text = " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[: rng.choice([2, 5, 26])], k=rng.randint(17, 120))).encode()
        found = pieces_of(text)
        assert b" ".join(text[a:b] for a, b, _ in found) == text and max(n for _, _, n in found) <= S.MOST_WORDS
        ends, plain = {b for _, b, _ in found}, text.split()
        hashes = [zlib.crc32(b, zlib.crc32(a)) for a, b in zip(plain, plain[1:], strict=False)]
        for i in range(len(hashes) - S.WINDOW + 1):
            near = hashes[i : i + S.WINDOW]
            if near.count(min(near)) == 1:
                assert 2 * (i + near.index(min(near))) + 3 in ends

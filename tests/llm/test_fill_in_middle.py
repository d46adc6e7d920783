"""Fill-in-middle against the unit pattern and plain slices."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import fill_in_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(rng, n):
    alphabet = ["a", "é", "🎈", "word", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", " ", "<", "<P", "S>", "<P>", "M>"]
    out = ["", None, " ", "\r\n", "a", " a ", "x" * 50_000, "w " * 60_000, "< P>", "a<P", "S>b"]
    return out + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts(random.Random(7), 400)))


def test_units_and_lengths_match_the_pattern():
    for text in filter(None, texts(random.Random(8), 600)):
        spaces, marked = M.events(text)
        assert M.unit_ends(spaces, len(text)).tolist() == [m.end() for m in UNIT.finditer(text)]
        assert marked == any(s in text for s in ("<P>", "<S>", "<M>"))


@pytest.mark.parametrize("rate", [50, 100])
def test_outputs_and_exact_round_trip(spark, rows, rate):
    got = M.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=rate)
    got = got.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got} == {d: plain(d, t, rate=rate) for d, t in rows}
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_edges(spark):
    odd = [(None, "a b c d"), (3, None), (3, ""), (5, "same text here"), (5, "same text here")]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("row", "cut", "n", "form", "third", "output", "marked")})
    got = M.fill_in_middle(df)
    assert sorted(got.columns) == sorted(["doc_id", "text", "row", "cut", "third", "marked", *M.NEW])
    rows = got.collect()
    assert sorted((str(r["doc_id"]), r["output"]) for r in rows) == sorted((str(d), plain(d, t)[-1]) for d, t in odd)
    assert {r["row"] for r in rows} == {r["third"] for r in rows} == {"mine"}
    assert M.fill_in_middle(df.limit(0)).count() == 0

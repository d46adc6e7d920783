"""Fill-in-middle: one automaton finds white space and sentinels; the gaps between its events count the units of a text."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The characters at which a text changes between words and white space.
SPACES = "\t\n\x0b\x0c\r "
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for char in SPACES:
        found.add_word(char, 0)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(sentinel, 1)
    found.make_automaton()
    return found


def events(text: str) -> tuple[np.ndarray, bool]:
    """Where white space stands, and whether the text has a sentinel, from one scan."""
    if not text:
        return np.zeros(0, np.int64), False
    found = np.fromiter((2 * end + kind for end, kind in _automaton().iter(text)), np.int64)
    return found[found & 1 == 0] >> 1, bool((found & 1).any())


def unit_ends(spaces: np.ndarray, length: int) -> np.ndarray:
    """Where each unit ends: a unit is white space and the word after it, or the white space that ends the text.

    Two neighbouring events with a gap between them have one word there, so no character but the events is looked at.
    """
    stops = np.append(spaces, length)
    ends = stops[np.diff(stops, prepend=-1) > 1]
    return np.append(ends, length) if len(spaces) and spaces[-1] == length - 1 else ends


@F.arrow_udf(StructType().add("n", "long").add("marked", "boolean").add("prefix_chars", "long").add("middle_chars", "long"))
def _cut(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    rows = []
    for value, *draws in zip(text, first, second, strict=True):
        whole = value.as_py()
        spaces, marked = events(whole)
        ends = unit_ends(spaces, len(whole))
        low, high = sorted(d.as_py() % (len(ends) + 1) for d in draws)
        start, stop = (int(ends[k - 1]) if k else 0 for k in (low, high))
        rows.append((len(ends), marked, start, stop - start))
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["n", "marked", "prefix_chars", "middle_chars"])


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output, the rearranged whole text.

    Two draws from a hash of seed and doc_id say after how many units the prefix and the middle end; a third says whether
    the text is rearranged (rate in 100), a fourth in which order. Texts that are empty (null too) or hold a sentinel stay plain, with
    null lengths. Texts are scanned whole and once, whatever their length, in 8 bytes for each white space; only four numbers a
    row come back from Python. No shuffle. A null doc_id draws as an empty one; copies of a row come back each and alike; an empty
    table stays empty; own columns of the new names are replaced, all others stay as they are.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(F.struct("*").alias("row"), _cut(text_of(), draws[0], draws[1]).alias("cut"), draws[2].alias("third"), draws[3].alias("fourth"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    plain = (F.col("cut.n") == 0) | F.col("cut.marked") | (F.col("third") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("fourth") % 100 < spm_rate, "spm").otherwise("psm")
    start, length = F.col("cut.prefix_chars").cast("int"), F.col("cut.middle_chars").cast("int")
    prefix, middle, suffix = F.substr(text, F.lit(1), start), F.substr(text, start + 1, length), F.substr(text, start + length + 1)
    orders = {"psm": (F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), "spm": (F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)}
    cut = lambda c: F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(c)
    output = F.when(F.col("form") == "psm", F.concat(*orders["psm"])).when(F.col("form") == "spm", F.concat(*orders["spm"])).otherwise(text)
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in NEW]
    return rows.withColumn("form", form).select(*own, F.col("cut.n").alias("n"), "form", cut("prefix_chars"), cut("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() rearranged: a rearranged text has no sentinel, so the three in its output part it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of each rearranged document; see fill_in_middle()."""
    done = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


OP12_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS t, ('0x' || h[25:32])::BIGINT % 100 AS f FROM units),
formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR t >= 50 THEN 'plain' WHEN f < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM formed
"""

"""The pipeline on odd tables, end to end."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "size score spans items n_words language kept target blob node row salt hit key mark secret copies".split()


def prose(word, n):
    return " ".join(f"{word}{i % 37}" if i % 5 else "and the" for i in range(n))


ROWS = [
    (1, prose("alpha", 80), "en", "a", 1), (1, prose("alpha", 80), "en", "a", 1), (2, prose("beta", 90) + " password = hunter2hunter2", "en", None, 1), (None, prose("gamma", 70), "en", "b", 1),
    (3, None, "en", "b", None), (4, "", "en", "b", 0), (4, " \t", None, "b", 2), (5, prose("delta", 60) + " one two three four five six seven eight nine ten", "en", "c", 1),
    (6, "zeta 123 éé " * 20_000, "en", "c", 1), (7, prose("alpha", 80), "en", "z", 1),
]


def tables(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "One, two three four five six; seven eight nine ten"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("clash", [True, False])
def test_odd_rows_run_through(spark, tmp_path, clash):
    docs = spark.createDataFrame(ROWS, SHAPE)
    if clash:
        docs = docs.withColumns({c: F.lit("mine") for c in CLASH})
    where, held = tables(spark, tmp_path, docs), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, where)
        assert held.columns == docs.columns
        if clash:
            assert {v for r in held.select(*CLASH).collect() for v in r} <= {"mine"}
    texts = {r["text"] for r in held.collect()}
    assert not any("hunter2" in t for t in texts) and not any("seven eight nine" in t for t in texts)
    got = corpus_pipeline.run(spark, where).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "6", "None"]
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)


def test_empty_tables_run_through(spark, tmp_path):
    where = tables(spark, tmp_path, spark.createDataFrame([], SHAPE))
    assert corpus_pipeline.run(spark, where).count() == 0

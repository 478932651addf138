"""Row numbers that a job takes are those another job finds, whatever the file splits are in between."""

import collections

import pytest

from epitide.llm import common, mixing, ngram_join, suffix_dedup

SETTING = "spark.sql.files.minPartitionNum"


@pytest.fixture()
def docs(spark, tmp_path):
    passage = "a passage of more than one hundred bytes that several of the documents share with each other, word by word, to the end"
    rows = [(i, f"document {i} has its own words w{i} x{i * 7} y{i * 11} " + (passage if i % 9 == 0 else f"and its own end {i * 13} {i * 17} {i * 19}"), "en", f"s{i % 3}", None) for i in range(4000)]
    rows += [(5000 + i, rows[i][1], "en", "s1", None) for i in range(40)] + [(7, rows[7][1], "en", "s0", None), (None, None, None, None, None)]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.option("parquet.block.size", 8192).parquet(path)
    return spark.read.parquet(path)


def shifting(spark, monkeypatch, *modules):
    """Every table that is written changes the number of splits of the next scan."""
    seen = iter(range(1, 10_000))
    plain = common.materialise

    def write(df, name):
        out = plain(df, name)
        spark.conf.set(SETTING, str(1 + next(seen) * 5 % 13))
        return out

    for module in modules:
        monkeypatch.setattr(module, "materialise", write)


def rows_of(df):
    return collections.Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("operator", [suffix_dedup.dedup, ngram_join.join_components, ngram_join.representatives, mixing.mixture])
def test_splits_may_change_between_jobs(spark, docs, monkeypatch, operator):
    spark.conf.set(SETTING, "2")
    try:
        want = rows_of(operator(docs))
        shifting(spark, monkeypatch, common, suffix_dedup, ngram_join, mixing)
        got = operator(docs)
        spark.conf.set(SETTING, "11")
        assert rows_of(got) == want
    finally:
        spark.conf.unset(SETTING)


def test_numbers_are_unique_and_stay(spark, docs):
    placed = common.numbered(docs)
    spark.conf.set(SETTING, "3")
    try:
        first = {(r["doc_id"], r["text"], r["_row"]) for r in placed.collect()}
        spark.conf.set(SETTING, "16")
        again = {(r["doc_id"], r["text"], r["_row"]) for r in placed.collect()}
    finally:
        spark.conf.unset(SETTING)
    assert first == again and len({r[2] for r in first}) == docs.count()
    made = common.numbered(spark.range(50).selectExpr("id as doc_id", "'x' as text"))  # not a read of files: written first
    assert made.select("_row").distinct().count() == 50
    assert common.numbered(docs.where("false")).collect() == []

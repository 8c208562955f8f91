"""Every pipeline stage on tables with columns of odd names and types, and on empty tables."""

import pytest

import corpus_pipeline
from rosterloom.llm.near_duplicates import without_near_duplicates
from rosterloom.llm.tables import looked_up

LONG = " ".join(f"word{i}" for i in range(80))
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars int, `a.b` string, "
          "tags map<string,int>, extra struct<key:int,rank:string>, key int, row int, rank int, chosen int")


def odd_table(spark, rows):
    return spark.createDataFrame(
        [(i, text, "en", "web", None if text is None else len(text), f"x{n}", {"a": n}, (n, "r"), n, n, n, n)
         for n, (i, text) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_odd_columns(spark, sf_dir, name, stage):
    docs = odd_table(spark, [(1, LONG), (1, LONG), (2, LONG), (3, LONG + " end"), (None, "Other words. " * 40), (4, None), (5, "")])
    after = stage(spark, docs, sf_dir)
    assert after.columns == docs.columns and after.dtypes == docs.dtypes
    assert {r.doc_id for r in after.collect()} <= {None, 1, 2, 3, 4, 5}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, sf_dir, name, stage):
    assert stage(spark, odd_table(spark, []), sf_dir).count() == 0


def test_one_row_of_each_group_whatever_its_columns(spark):
    docs = odd_table(spark, [(1, LONG), (1, LONG), (2, LONG), (3, LONG + " end"), (7, "short text")])
    kept = without_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 7]
    assert {r.tags["a"] for r in kept} <= {0, 1, 4}


def test_lookups_deal_heavy_keys(spark):
    rows = spark.createDataFrame([("hot", i, 1) for i in range(5000)] + [(f"k{i}", i, 2) for i in range(3000)] + [(None, 0, 3)],
                                 "key string, part int, n int")
    known = spark.createDataFrame([("hot", 7), ("k1", 8), ("k2", 9), ("other", 10), (None, 11)], "key string, parts int")
    got = looked_up(rows, known, "key")
    assert got.columns == ["key", "part", "n", "parts"]
    assert sorted(map(tuple, got.collect())) == sorted([("hot", i, 1, 7) for i in range(5000)] + [("k1", 1, 2, 8), ("k2", 2, 2, 9)])
    assert looked_up(rows.limit(0), known, "key").count() == 0

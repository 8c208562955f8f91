"""The registered queries: against SQL where there is some, else against their contracts."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from rosterloom.llm import oracles
from rosterloom.llm.queries import QUERIES
from rosterloom.llm.tables import table

TABLES = "documents embeddings pages benchmark labels conversations".split()
COLUMNS = {
    "op3_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_minhash_near_dedup": {"doc_id", "component_id", "kept"},
    "op8_token_file": {"doc_id", "start", "n_tokens", "ids_crc32"},
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, sf_dir, duck, name):
    mine = QUERIES[name](spark, sf_dir)
    theirs = duck.sql(oracles.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    expected = Counter(tuple(r[i] for i in order) for r in theirs.fetchall())
    assert expected and Counter(map(tuple, mine.select(*columns).collect())) == expected


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    assert set(got.columns) == COLUMNS[name]
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in table(spark, sf_dir, "documents").select("doc_id").collect())


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        before = after
    kept = {r.doc_id for r in before.select("doc_id").collect()}
    toxic = {r.doc_id for r in QUERIES["op4_toxicity"](spark, sf_dir).filter("predicted = 1").collect()}
    assert kept and not kept & toxic
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.filter("NOT lossless").count() == 0
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == kept

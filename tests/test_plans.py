"""The shape of plans: what is read, pushed down, broadcast and joined."""

import re

import pytest

from rosterloom.operators.clean import restrict_to_batch
from rosterloom.operators.link import linked_pairs
from rosterloom.plans.batch import batch_results
from rosterloom.plans.summary import head_counts
from rosterloom.queries import CROWDED, QUERIES, linked, snapshots


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """Plan as for tables too large to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield spark
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_compares_all_with_all(large, sf_dir, name):
    text = plan(QUERIES[name](large, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text or name == "district_count"


def test_head_counts_read_two_columns(spark, sf_dir):
    registry, upload = snapshots(spark, sf_dir)
    text = plan(head_counts(restrict_to_batch(registry, upload), upload))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert set(re.findall(r"(\w+):", schema)) <= {
            "primero_aun9_3", "primero_pasecureid", "sebt_aun9_3", "sebt_pasecureid"}
    assert "PushedFilters: [In(primero_aun9_3" in text


def test_choosing_keys_shuffles_rows_once(large, sf_dir):
    text = plan(QUERIES["key_cascade"](large, sf_dir))
    exchanges = re.findall(r"Exchange hashpartitioning\((join_key1?)#", text)
    # Each side: its rows. Their shared ID keys are counted for both sides at once, and used twice.
    assert set(exchanges) == {"join_key1"} and len(exchanges) <= 4


def test_one_sided_ids_take_one_shuffle(large, sf_dir, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter
    snapshots(large, sf_dir)
    plans, write = [], DataFrameWriter.parquet

    def seen(self, path, *args, **kwargs):
        plans.append(plan(self._df))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    result = QUERIES["one_sided_ids"](large, sf_dir)
    assert len(plans) == 1 and re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plans[0])
    assert len(re.findall("Exchange hashpartitioning", plans[0])) == 1
    assert "Exchange" not in plan(result)


def test_pairs_of_hot_keys_join_on_slices(large, sf_dir):
    link = linked(large, sf_dir, CROWDED)
    assert link.hot
    assert re.search(r"hashpartitioning\(join_key#\d+, _left#\d+\w*, _right#", plan(linked_pairs(link)))


def test_a_stored_linkage_is_not_shuffled_again(large, sf_dir, tmp_path):
    kept = linked(large, sf_dir).stored(str(tmp_path / "keyed"))
    results = batch_results(kept)
    for name in ("unmatched_registry", "unmatched_upload", "duplicate_keys_registry",
                 "duplicate_key_rows", "many_to_many_keys", "district_summary"):
        assert not re.search(r"Exchange hashpartitioning\(join_key", plan(results[name])), name
    kept.release()

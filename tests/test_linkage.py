import random
from collections import Counter
from dataclasses import replace

import pytest
from helpers import TIGHT, rosters
from pyspark.sql import functions as F

from rosterloom.config import MatchConfig, ScaleLimits
from rosterloom.operators.clean import clean_keys, keep_identified, prefix_columns, restrict_to_batch
from rosterloom.operators.compare import mismatched_pairs, scored_pairs
from rosterloom.operators.exceptions import one_sided_ids
from rosterloom.operators.link import (
    duplicate_key_rows, duplicate_keys, link_rosters, link_sizes, linked_distinct_pairs, linked_pairs,
    many_to_many_keys, unmatched,
)
from rosterloom.operators.skew import HotKeys, broadcast_if_small, with_row_numbers

CFG = MatchConfig()
TIGHT_CFG = replace(CFG, limits=TIGHT)


def link(spark, registry, upload, cfg=CFG):
    return link_rosters(*rosters(spark, registry, upload, cfg), cfg)


def pairs(linkage):
    rows = linked_pairs(linkage).select("primero_pasecureid", "sebt_pasecureid").collect()
    return sorted(tuple(r) for r in rows)


def test_prefix_and_clean(spark):
    df = prefix_columns(spark.createDataFrame([(" A ", " B ")], "x string, y string"), "p", keep=("y",))
    assert df.columns == ["p_x", "y"]
    assert tuple(clean_keys(df, ["p_x"]).first()) == ("a", " B ")


def test_rows_without_district_or_id_are_dropped(spark):
    df = spark.createDataFrame([("1", "a"), ("", "b"), (None, "c"), ("2", None), ("3", "")], "d string, i string")
    assert [tuple(r) for r in keep_identified(df, ["d", "i"]).collect()] == [("1", "a")]


@pytest.mark.parametrize("limits", [
    ScaleLimits(), ScaleLimits(listed_districts=1), ScaleLimits(listed_districts=1, broadcast_bytes=1),
    TIGHT], ids=["filter", "broadcast", "shuffle", "sliced"])
def test_batch_restriction(spark, limits):
    cfg = replace(CFG, limits=limits)
    registry = [{"aun9_3": d, "pasecureid": str(i)} for i, d in enumerate("1112344444444")]
    upload = [{"aun9_3": d, "pasecureid": "x"} for d in (" 1 ", "4", "4", "5")]
    kept = restrict_to_batch(*rosters(spark, registry, upload, cfg), cfg)
    assert Counter(r.primero_aun9_3 for r in kept.collect()) == {"1": 3, "4": 8}
    assert not [c for c in kept.columns if c.startswith("_")]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_long_list_of_districts_does_not_shuffle_the_registry(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    usual = {name: spark.conf.get(name, None) for name in names}
    spark.conf.set(names[0], 100_000)
    spark.conf.set(names[1], -1)
    try:
        found = restrict_to_batch(*rosters(spark, [{"aun9_3": d} | {"pasecureid": "1"} for d in "123"],
                                           [{"aun9_3": d} | {"pasecureid": "1"} for d in "235"], TIGHT_CFG), TIGHT_CFG)
        assert "hashpartitioning" not in physical(found)
        assert sorted(r.primero_aun9_3 for r in found.collect()) == ["2", "3"]
    finally:
        for name, value in usual.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_rows_decided_by_their_id_are_not_looked_up_again(spark):
    registry, upload = random_rosters(7)
    found = link(spark, registry, upload)
    for side in CFG.sides:
        assert physical(unmatched(found, side)).count("LeftAnti") == 2
    assert "_wanted" in physical(duplicate_key_rows(found))


@pytest.mark.parametrize("cfg", [CFG, TIGHT_CFG, replace(CFG, match_missing_names=False)], ids=["usual", "tight", "named"])
@pytest.mark.parametrize("seed", [3, 4])
def test_lookups_against_the_chosen_keys(spark, seed, cfg, tmp_path):
    """Unmatched and duplicate rows as the chosen keys give them, also where an ID is spelt like a name, and from stored rows."""
    registry, upload = random_rosters(seed)
    spelt = {"pasecureid": "a_ash_2015", "student_first_name": "x"}
    named = {"student_first_name": "a", "student_last_name": "ash", "student_dob": "2015"}
    registry += [spelt, named | {"pasecureid": "only-p"}, named | {"pasecureid": "only-q"}]
    upload += [spelt, spelt, named | {"pasecureid": "only-s"}]
    found = link(spark, registry, upload, cfg)
    keyed = {side: [r.asDict() for r in found.rows(side).drop("_row").collect()] for side in cfg.sides}
    counts = {side: Counter(r["join_key"] for r in rows if r["join_key"] is not None) for side, rows in keyed.items()}

    def told(rows):
        return Counter(tuple(sorted(r.items(), key=lambda x: x[0])) for r in rows)

    for here in (found, found.stored(str(tmp_path / "kept"))):
        for side, other in (cfg.sides, cfg.sides[::-1]):
            expected = [r for r in keyed[side] if r["join_key"] not in counts[other]]
            assert expected and told(r.asDict() for r in unmatched(here, side).collect()) == told(expected)
        dups = {k: n for k, n in counts[cfg.registry].items() if n > 1}
        expected = [r | {"n": dups[r["join_key"]]} for r in keyed[cfg.upload] if r["join_key"] in dups]
        assert any(r["join_key"] == "1_a_ash_2015" for r in expected)
        assert told(r.asDict() for r in duplicate_key_rows(here).collect()) == told(expected)
        here.release()


def test_cascade(spark):
    found = link(spark, [
        {"pasecureid": "1", "student_first_name": "a"},
        {"pasecureid": "2", "student_first_name": "b"},
        {"pasecureid": "3", "student_first_name": "c"},
        {"pasecureid": "4", "student_first_name": "d", "aun9_3": "2"},
        {"pasecureid": "5", "student_first_name": "z"},
    ], [
        {"pasecureid": "1", "student_first_name": "other"},        # by ID, names differ
        {"pasecureid": "22", "student_first_name": " B "},         # by name
        {"pasecureid": "33", "student_first_name": "c", "student_dob": "2014-01-01"},  # neither
        {"pasecureid": "44", "student_first_name": "d"},           # same name, other district
        {"pasecureid": "9", "aun9_3": "2", "student_first_name": "y"},
    ])
    assert pairs(found) == [("1", "1"), ("2", "22")]


def test_a_row_known_by_id_is_not_tried_by_name(spark):
    found = link(spark, [{"pasecureid": "1"}, {"pasecureid": "2", "student_first_name": "x"}],
                 [{"pasecureid": "1", "student_first_name": "x"}, {"pasecureid": "7", "student_first_name": "x"}])
    assert pairs(found) == [("1", "1"), ("2", "7")]


def test_missing_names(spark):
    nameless = {"student_first_name": None, "student_last_name": None, "student_dob": None}
    sides = [{"pasecureid": "1"} | nameless], [{"pasecureid": "2"} | nameless]
    assert pairs(link(spark, *sides)) == [("1", "2")]
    strict = link(spark, *sides, replace(CFG, match_missing_names=False))
    assert pairs(strict) == []
    assert unmatched(strict, CFG.registry).count() == unmatched(strict, CFG.upload).count() == 1


def test_duplicates(spark):
    found = link(spark, [{"pasecureid": s} for s in ("1", "1", "2", "3", "3")],
                 [{"pasecureid": s, "student_first_name": "u"} for s in ("1", "2", "2", "3", "3", "3")])
    assert {tuple(r) for r in duplicate_keys(found, CFG.registry).collect()} == {("1_1", 2), ("1_3", 2)}
    assert {tuple(r) for r in duplicate_keys(found, CFG.upload).collect()} == {("1_2", 2), ("1_3", 3)}
    rows = duplicate_key_rows(found).select("join_key", "n", "sebt_pasecureid").collect()
    assert sorted(tuple(r) for r in rows) == [("1_1", 2, "1")] + [("1_3", 2, "3")] * 3
    assert [tuple(r) for r in many_to_many_keys(found).collect()] == [("1_3", 2, 3)]
    assert {tuple(r) for r in link_sizes(found).collect()} == {("1_1", 2, 1), ("1_2", 1, 2), ("1_3", 2, 3)}


def test_one_sided_ids_compare_by_id_within_the_district(spark):
    found = link(spark, [{"pasecureid": "1"}, {"pasecureid": "1"}, {"pasecureid": "2"}],
                 [{"pasecureid": "1", "student_first_name": "B"}, {"pasecureid": "3"},
                  {"pasecureid": "2", "aun9_3": "9", "student_first_name": None}])
    rows = one_sided_ids(found)
    assert rows.columns == ["AUN", "PAsecureID", "FirstName", "LastName", "Source"]
    assert sorted((r.AUN, r.PAsecureID, r.Source) for r in rows.collect()) == [
        ("1", "2", "Primero"), ("1", "3", "SEBT"), ("9", "2", "SEBT")]


def test_mismatched_pairs(spark):
    found = link(spark, [
        {"pasecureid": "1", "school_code4": "0012"}, {"pasecureid": "2", "school_code4": None},
        {"pasecureid": "3", "parent_first_name": "ann"}, {"pasecureid": "4", "parent_first_name": None},
        {"pasecureid": "5", "case_number": "CASE1"}, {"pasecureid": "6", "student_address1": "12 oak st"},
        {"pasecureid": "7", "student_address1": "..."}, {"pasecureid": "8", "student_address1": ""}],
        [{"pasecureid": "1", "school_code4": "12"}, {"pasecureid": "2", "school_code4": "1"},
         {"pasecureid": "3", "parent_first_name": ""}, {"pasecureid": "4", "parent_first_name": "ann"},
         {"pasecureid": "5", "case_number": "case1"}, {"pasecureid": "6", "student_address1": "12 Oak Streett"},
         {"pasecureid": "7", "student_address1": "."}, {"pasecureid": "8", "student_address1": "1 x"}])
    expected = {"school_code": ["1"], "parent_name": ["3"], "case_number": ["5"], "address": ["6"]}
    for field, ids in expected.items():
        got = mismatched_pairs(found, field)
        assert [r.sebt_pasecureid for r in got.collect()] == ids, field
    scores = {r.sebt_pasecureid: r.addr_similarity for r in scored_pairs(found).collect()}
    assert scores["7"] == 1.0 and scores["8"] is None and scores["1"] == 1.0
    assert scores["6"] < 0.9


def random_rosters(seed, n=120):
    """Rosters with a third of all rows under one ID, another crowd under one null name."""
    rng = random.Random(seed)

    def row(side):
        kind = rng.random()
        name = rng.choice([None, "a", "b", "c"])
        out = {"aun9_3": rng.choice("12"), "pasecureid": str(rng.randrange(40)), "student_first_name": name,
               "student_dob": rng.choice([None, "2015", "2016"]),
               "eligibility": rng.choice(["Free", "PAID", "reduced", "Denied", None]),
               "school_code4": rng.choice([None, "1", "2"]), "case_number": rng.choice([None, "x", "y"]),
               "parent_first_name": rng.choice([None, "", "p", "pq"]),
               "parent_last_name": rng.choice(["q", "r", None]),
               "student_address1": rng.choice([None, "", "12 Oak Street", "12 oak st.", "13 Oak St", "9 Elm Ave", ".",
                                               "12 oka st", "112 Oak Street"])}
        if kind < 0.34:
            out |= {"aun9_3": "1", "pasecureid": "placeholder"}
        elif kind < 0.5:
            out |= {"aun9_3": "2", "pasecureid": f"{side}{rng.randrange(99)}", "student_first_name": None,
                    "student_last_name": None, "student_dob": None}
        return out

    return [row("p") for _ in range(n)], [row("s") for _ in range(n)]


def test_one_sided_ids_have_all_their_names(spark):
    """One name, two, and many under an ID of one side; names missing; IDs of both sides left out."""
    names = {"1": ["a"], "2": ["a", "b"], "3": ["a", "b", "c", "d", None], "4": [None], "5": ["a", "a"], "6": ["x", "y"]}
    rows = [{"pasecureid": i, "student_first_name": n} for i, all_of_it in names.items() for n in all_of_it]
    found = link(spark, rows, [{"pasecureid": "6"}, {"pasecureid": "7", "student_first_name": "u"},
                               {"pasecureid": "1", "aun9_3": "2"}])
    got = Counter((r.AUN, r.PAsecureID, r.FirstName, r.Source) for r in one_sided_ids(found).collect())
    listed = {(i, n) for i, all_of_it in names.items() for n in all_of_it if i != "6"}
    # The registry is cut to the districts of the batch; both are in it here.
    assert got == Counter([("1", i, n, "Primero") for i, n in listed] + [("1", "7", "u", "SEBT"), ("2", "1", "ann", "SEBT")])


def test_choosing_keys_runs_no_job(spark, monkeypatch):
    from rosterloom.operators.skew import HotKeys

    def fail(*_):
        raise AssertionError("counted")

    monkeypatch.setattr(HotKeys, "find", fail)
    registry, upload = random_rosters(3)
    found = link(spark, registry, upload)
    for result in (unmatched(found, CFG.registry), duplicate_key_rows(found), link_sizes(found), one_sided_ids(found)):
        assert result.columns


@pytest.mark.parametrize("seed", [1, 2])
def test_slicing_changes_nothing(spark, seed):
    registry, upload = random_rosters(seed)
    usual, sliced = (link(spark, registry, upload, cfg) for cfg in (CFG, TIGHT_CFG))
    assert not usual.hot and sliced.hot

    def rows(df):
        return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())

    for result in (linked_pairs, one_sided_ids, duplicate_key_rows, link_sizes,
                   lambda x: unmatched(x, CFG.registry), lambda x: unmatched(x, CFG.upload),
                   lambda x: x.rows(CFG.upload).drop("_row")):
        assert rows(result(usual)) == rows(result(sliced))
    p = usual.registry.count()
    matched = usual.registry.join(usual.upload.select("join_key").distinct(), "join_key", "left_semi").count()
    assert p == matched + unmatched(usual, CFG.registry).count()


def test_hot_keys_are_spread(spark):
    registry, upload = random_rosters(5, 300)
    found = link(spark, registry, upload, TIGHT_CFG)
    sized = found.hot._sized(found.registry, F.col("join_key"), _lefts=found.hot._grid()[0])
    rows = sized.withColumn("at", found.hot._own("_lefts")).groupBy("join_key").agg(
        F.count("*").alias("n"), F.count_distinct("at").alias("slices")).collect()
    crowd = next(r for r in rows if r.join_key == "1_placeholder")
    assert crowd.n > 90 and crowd.slices >= crowd.n // 8


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("n, m", [(95, 95), (1, 99), (99, 2), (40, 30)])
def test_no_two_slices_stand_for_many_pairs(spark, n, m, small):
    """Sides just under the limit of rows are sliced by their pairs, and no pair is lost."""
    limits = ScaleLimits(slice_rows=100, slice_pairs=50, broadcast_bytes=10_000 if small else 1)
    left, right = (with_row_numbers(spark.range(size).selectExpr("'k' AS k", f"id AS {name}"))
                   for name, size in (("a", n), ("b", m)))
    hot = HotKeys.find([(left, ["k"]), (right, ["k"])], limits)
    assert hot and hot.small == small and hot.most_pairs == n * m
    joined = hot.join_pairs(left, right, "k")
    assert joined.count() == joined.distinct().count() == n * m
    sizes = hot.sizes.select(*[c.alias(x) for x, c in zip("xy", hot._grid())], "n", "m").first()
    assert (sizes.n / sizes.x) * (sizes.m / sizes.y) <= 50


def test_low_limits_do_not_copy_rows_without_end(spark):
    """A key of 4 million pairs under limits of a few rows: enough slices to occupy the tasks, not a million cells."""
    limits = ScaleLimits(slice_rows=2, slice_pairs=4, broadcast_bytes=1)
    left, right = (with_row_numbers(spark.range(2000).selectExpr("'k' AS k", f"id AS {name}")) for name in "ab")
    hot = HotKeys.find([(left, ["k"]), (right, ["k"])], limits)
    x, y = hot.sizes.select(*hot._grid()).first()
    assert 1000 <= x * y <= 8192
    joined = hot.join_pairs(left, right, "k")
    assert joined.agg(F.count("*"), F.sum("a"), F.sum("b")).first()[:] == (4_000_000, 2000 * 1_999_000, 2000 * 1_999_000)


def above_products(df):
    """The operator right above each product in the plan."""
    lines = physical(df).splitlines()
    bare = [line.lstrip(" :+-") for line in lines]
    depth = [len(line) - len(name) for line, name in zip(lines, bare)]
    return [next(bare[j] for j in range(i, -1, -1) if depth[j] < depth[i])
            for i, name in enumerate(bare) if name.startswith("CartesianProduct")]


def test_pairs_of_a_heavy_key_are_put_together_without_copies(spark):
    """A key of 16 million pairs is a product of parts, whose columns are in order before: rows are neither copied
    for slices nor written anew for every pair."""
    limits = ScaleLimits(slice_rows=5, slice_pairs=50, broadcast_bytes=1)
    left, right = (with_row_numbers(spark.range(4001).selectExpr(f"id AS {name}", "IF(id < 4000, 'k', 'other') AS k"))
                   for name in "ab")
    hot = HotKeys.find([(left, ["k"]), (right, ["k"])], limits)
    joined = hot.join_pairs(left, right, "k")
    assert joined.columns == ["k", "a", "b"]
    assert above_products(joined) == ["Union"]
    assert joined.agg(F.count("*"), F.sum("a"), F.sum("b")).first()[:] == (
        16_000_001, 4000 * 7_998_000 + 4000, 4000 * 7_998_000 + 4000)


@pytest.mark.parametrize("most", [1, 2, 16])
@pytest.mark.parametrize("tight", [False, True])
def test_heavy_keys_light_keys_and_short_sides(spark, tight, most):
    def side(sizes, name):
        keys = [None if k == "null" else k for k, size in sizes.items() for _ in range(size)]
        rows = spark.createDataFrame(list(enumerate(keys)), f"{name} long, k string")
        return with_row_numbers(rows.repartition(3, name))

    left = side({"a": 60, "b": 40, "c": 3, "one": 1, "many": 2000, "alone": 99, "null": 50}, "x")
    right = side({"a": 50, "b": 45, "c": 2, "one": 2000, "many": 1, "other": 99, "null": 50}, "y")
    small = {"slice_rows": 5, "slice_pairs": 50, "broadcast_bytes": 1} if tight else {}
    hot = HotKeys.find([(left, ["k"]), (right, ["k"])], ScaleLimits(cross_pairs=1000, cross_keys=most, **small))
    assert bool(hot) == tight and len(hot.heaviest) == min(most, 2)
    joined = hot.join_pairs(left, right, "k")
    assert len(above_products(joined)) == min(most, 2)
    expected = left.drop("_row").join(right.drop("_row"), "k")
    assert joined.dtypes == expected.dtypes
    assert Counter(joined.collect()) == Counter(expected.collect())


@pytest.mark.parametrize("limits", [ScaleLimits(cross_pairs=100), replace(TIGHT, cross_pairs=100)], ids=["usual", "tight"])
def test_products_change_nothing(spark, limits):
    registry, upload = random_rosters(6, 200)
    usual, found = (link(spark, registry + registry[:50], upload + upload[:40], cfg) for cfg in (CFG, replace(CFG, limits=limits)))
    assert not usual.hot.heaviest and found.hot.heaviest
    for result in (linked_pairs, linked_distinct_pairs, scored_pairs, lambda x: mismatched_pairs(x, "address"),
                   lambda x: mismatched_pairs(x, "parent_name")):
        mine, theirs = result(found), result(usual)
        assert sorted(mine.columns) == sorted(theirs.columns) and "CartesianProduct" in physical(mine)
        assert Counter(mine.select(theirs.columns).collect()) == Counter(theirs.collect())


def test_keys_under_all_limits_are_not_hot(spark):
    rows = with_row_numbers(spark.createDataFrame([("a",), ("a",), (None,)], "k string"))
    hot = HotKeys.find([(rows, ["k"]), (rows, ["k"])], ScaleLimits(slice_rows=2, slice_pairs=4, pair_limit=4))
    assert not hot and hot.most_pairs == 0
    nulls = with_row_numbers(spark.createDataFrame([(None,)] * 9, "k string"))
    hot = HotKeys.find([(nulls, ["k"]), (nulls, ["k"])], ScaleLimits(slice_rows=2, slice_pairs=4, pair_limit=4))
    assert hot and hot.most_pairs == 0
    assert hot.join_pairs(nulls, nulls, "k").count() == 0


def test_broadcast_only_after_measuring(spark):
    df = spark.createDataFrame([("x" * 100,)] * 10, "a string")
    assert broadcast_if_small(df, ScaleLimits(broadcast_bytes=2000)) is not df
    assert broadcast_if_small(df, ScaleLimits(broadcast_bytes=500)) is df


def test_limits_are_checked():
    with pytest.raises(ValueError):
        ScaleLimits(slice_pairs=0)
    with pytest.raises(ValueError):
        MatchConfig(address_threshold=0.5)

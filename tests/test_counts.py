"""Counts over pairs: by joining, by sizes, and by looking at every pair in Python."""

from collections import Counter
from dataclasses import replace

import pytest
from helpers import TIGHT, rosters, scalar_jaro
from pyspark.sql import functions as F
from test_linkage import link, random_rosters

from rosterloom.config import MatchConfig, ScaleLimits
from rosterloom.operators.compare import FIELDS, count_name
from rosterloom.operators.link import linked_pairs
from rosterloom.operators.close_pairs import candidates, class_lengths, length_class, least_common, subset_size
from rosterloom.operators.pair_counts import _close_pairs, crowded_keys, pair_counts
from rosterloom.plans.enrollment import district_count, enrollment_check
from rosterloom.plans.summary import district_summary, eligibility_wide, head_counts, id_lengths, mismatch_counts

CFG = MatchConfig()
TIGHT_CFG = replace(CFG, limits=TIGHT)


def by_hand(linkage):
    """Every pair, one after the other."""
    from rosterloom.functions.text import standardize_address
    pairs = linked_pairs(linkage).withColumns({
        side: standardize_address(F.col(f"{side}_student_address1")) for side in ("primero", "sebt")})
    counts = {}
    for r in pairs.collect():
        c = counts.setdefault(r.sebt_aun9_3, Counter())
        for side in ("sebt", "primero"):
            elig = (r[f"{side}_eligibility"] or "").lower()
            if elig in CFG.eligibility_values:
                c[f"{side}_{elig}"] += 1

        def both(name):
            return r[f"sebt_{name}"], r[f"primero_{name}"]

        def known(*names):
            return all(v is not None for n in names for v in both(n))

        c[count_name("school_code")] += known("school_code4") and len(set(both("school_code4"))) > 1
        c[count_name("case_number")] += known("case_number") and len(set(both("case_number"))) > 1
        c[count_name("parent_name")] += known("parent_first_name", "parent_last_name") and (
            len(set(both("parent_first_name"))) > 1 or len(set(both("parent_last_name"))) > 1)
        if all(both("student_address1")):
            c[count_name("address")] += scalar_jaro(r.sebt, r.primero) < 0.9
    return counts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_ways_of_counting_agree(spark, seed):
    registry, upload = random_rosters(seed)
    usual, tight = (link(spark, registry, upload, cfg) for cfg in (CFG, TIGHT_CFG))
    for linkage, some in ((usual, False), (tight, True)):
        assert (crowded_keys(linkage.registry, linkage.upload, linkage.cfg) is not None) == some
    expected = by_hand(usual)
    for linkage in (usual, tight):
        got = {r.AUN: {k: v for k, v in r.asDict().items() if k != "AUN"} for r in pair_counts(linkage).collect()}
        assert set(got) == set(expected)
        for aun, row in got.items():
            assert row == {name: expected[aun][name] for name in row}, aun


def test_close_addresses_are_all_found(spark):
    """The candidate search against all pairs, on many near and far texts of all lengths."""
    import random
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé1 ") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 21, 40, 70, 90, 140])))
             for _ in range(40)]

    def near(text):
        chars = list(text)
        for _ in range(rng.randint(0, max(1, len(chars) // 8))):
            at = rng.randrange(len(chars))
            kind = rng.random()
            if kind < 0.4:
                chars[at] = rng.choice("abcdeé1 ")
            elif kind < 0.7 and len(chars) > 1:
                del chars[at]
            else:
                chars.insert(at, rng.choice("abcdeé1 "))
        return "".join(chars)

    p = sorted({near(rng.choice(words)) for _ in range(150)})
    s = sorted({near(rng.choice(words)) for _ in range(150)})
    for threshold in (0.9, 0.75, 1.0):
        cfg = replace(CFG, address_threshold=threshold)
        pv = spark.createDataFrame([("k", "address", v, 1 + i % 3) for i, v in enumerate(p)],
                                   "join_key string, field string, value string, np bigint")
        sv = spark.createDataFrame([("k", "1", "address", v, 1 + i % 2) for i, v in enumerate(s)],
                                   "join_key string, AUN string, field string, value string, ns bigint")
        got = _close_pairs(pv, sv, cfg).collect()
        expected = sum((1 + i % 3) * (1 + j % 2) for i, a in enumerate(p) for j, b in enumerate(s)
                       if a != b and scalar_jaro(b, a) >= threshold)
        assert sum(int(r.n) for r in got) == expected
        if threshold < 1:
            assert expected > 100


def test_length_classes():
    classes = [length_class(n) for n in range(1, 3000)]
    assert all(a <= b for a, b in zip(classes, classes[1:]))
    for n, c in enumerate(classes, 1):
        least, most = class_lengths(c)
        assert least <= n <= most and length_class(least) == length_class(most) == c


def test_subsets_are_as_large_from_either_side():
    for t in (0.7, 0.9, 1.0):
        for a in range(1, 130):
            for b in range(1, 130):
                assert subset_size(a, b, t) == subset_size(b, a, t)
                if a <= 64 and b <= 64 and subset_size(a, b, t):
                    assert subset_size(a, b, t) <= least_common(a, b, t)


@pytest.mark.parametrize("hot", [False, True])
def test_few_pairs_of_like_addresses_are_formed(spark, hot):
    """1,500 addresses a side under one key, of a few streets: few pairs share a subset, and none that counts is missing."""
    import random
    rng = random.Random(2)
    streets = [f"{a} {b}" for a in ("oak", "main", "elm", "maple", "washington", "lake", "hill", "church") for b in ("st", "ave", "rd")]
    p, s = (sorted({f"{rng.randint(1, 4000)} {rng.choice(streets)}" for _ in range(1500)}) for _ in "ps")
    limits = ScaleLimits(slice_rows=20, slice_pairs=100, broadcast_bytes=1) if hot else ScaleLimits()
    pv, sv = (spark.createDataFrame([("k", v, 1) for v in values], f"join_key string, value string, n{side} bigint")
              for side, values in (("p", p), ("s", s)))
    texts, pairs = candidates(pv, sv, replace(CFG, limits=limits))
    formed = {(r.p_id, r.s_id) for r in pairs.collect()}
    assert len(formed) < 0.02 * len(p) * len(s)
    names = {r.id: r.value for r in texts.collect()}
    formed = {(names[a], names[b]) for a, b in formed}
    for a in p[::40]:
        for b in s:
            if a != b and scalar_jaro(b, a) >= 0.9:
                assert (a, b) in formed


def test_products_beyond_a_long(spark):
    """Two crowds of a few billion rows each stand for more pairs than a long can count."""
    from rosterloom.operators.pair_counts import _product
    df = spark.createDataFrame([(4_000_000_000, 4_000_000_000)], "np bigint, ns bigint")
    assert int(df.agg(_product().alias("n")).first().n) == 16 * 10**18


def test_eligibility_on_one_side_only(spark):
    upload = [{"pasecureid": str(i), "eligibility": "FREE"} for i in range(5)]
    registry = [{"pasecureid": str(i), "eligibility": "Denied"} for i in range(5)]
    for cfg in (CFG, TIGHT_CFG):
        found = link(spark, registry, upload, cfg)
        wide = eligibility_wide(found).first()
        assert (wide.sebt_free, wide.primero_free, wide.diff_free) == (5, None, None)
        row = district_summary(found).first()
        assert (row.sebt_free, row.primero_free, row.diff_free) == (5, 0, 0)


def test_eligibility_is_lowered_but_not_trimmed(spark):
    found = link(spark, [{"pasecureid": str(i), "eligibility": "Free"} for i in range(3)],
                 [{"pasecureid": str(i), "eligibility": e} for i, e in enumerate(["FREE", "free ", "Denied"])])
    row = eligibility_wide(found).first()
    assert (row.sebt_free, row.sebt_paid, row.primero_free, row.diff_free, row.diff_paid) == (1, 0, 3, -2, 0)


def test_districts_without_countable_eligibility_do_not_appear(spark):
    found = link(spark, [{"pasecureid": "1", "eligibility": None}], [{"pasecureid": "1", "eligibility": "x"}])
    assert eligibility_wide(found).count() == 0
    assert mismatch_counts(found, "address").count() == 0


def test_summary_shape(spark):
    found = link(spark, [{"aun9_3": "1", "pasecureid": "0123456789"}, {"aun9_3": "3", "pasecureid": "3"}],
                 [{"aun9_3": "2", "pasecureid": "2"}, {"aun9_3": "1", "pasecureid": "123456789"}])
    got = district_summary(found)
    assert got.columns == [
        "AUN", "p_total", "s_total", "difference", "sebt_free", "sebt_paid", "sebt_reduced",
        "primero_free", "primero_paid", "primero_reduced", "diff_free", "diff_paid", "diff_reduced",
        "p10digit_pasecureIDs", "p_not_pasecure", "s10digit_pasecureIDs", "s_not_pasecure",
        *map(count_name, FIELDS)]
    assert {t for _, t in got.dtypes[1:]} == {"bigint"}
    rows = [tuple(r[:4]) + (r.p10digit_pasecureIDs, r.s_not_pasecure) for r in got.collect()]
    assert rows == [("1", 1, 1, 0, 1, 1), ("2", 0, 1, -1, 0, 1)]


def test_head_counts_and_id_lengths(spark):
    p, s = rosters(spark, [{"pasecureid": "0123456789"}] * 2, [{"aun9_3": "2", "pasecureid": "12"}])
    assert {tuple(r) for r in head_counts(p, s).collect()} == {("1", 2, 0, 2), ("2", 0, 1, -1)}
    assert {tuple(r) for r in id_lengths(p, s).collect()} == {("1", 2, 0, None, None), ("2", None, None, 0, 1)}


def test_enrollment(spark):
    upload = spark.createDataFrame(
        [("1-2", "a"), ("12", "a"), (None, "a"), ("9", "b"), ("12", "c"), ("3", "c")], "aun9_3 string, sfa_name string")
    official = spark.createDataFrame([("12", "x", 50), ("3", "x", 70), ("8", "x", 1)], "AUN string, County string, Total bigint")
    got = {r.sfa_name: (r.SEBT_Count, r.Official_Enrollment) for r in enrollment_check(upload, official).collect()}
    assert got == {"a": (3, 50), "b": (1, None), "c": (2, 70)}
    twice = official.unionAll(spark.createDataFrame([("12", "y", 60)], official.schema))
    got = {r.sfa_name: (r.SEBT_Count, r.Official_Enrollment) for r in enrollment_check(upload, twice).collect()}
    assert got["a"] == (5, 60)  # a left join repeats rows of a repeated number
    assert district_count(upload, "aun9_3").first()[0] == 5  # the missing one counts


def test_empty_rosters(spark):
    for cfg in (CFG, TIGHT_CFG):
        assert district_summary(link(spark, [], [], cfg)).collect() == []
        found = link(spark, [], [{"pasecureid": "1"}], cfg)
        assert [(r.AUN, r.p_total, r.s_total) for r in district_summary(found).collect()] == [("1", 0, 1)]


@pytest.mark.parametrize("limits", [ScaleLimits(), ScaleLimits(slice_rows=8)])
def test_stored_linkage(spark, tmp_path, limits):
    registry, upload = random_rosters(4)
    found = link(spark, registry, upload, replace(CFG, limits=limits))
    kept = found.stored(str(tmp_path / "keyed"))
    assert bool(kept.tables) != bool(found.hot)
    assert district_summary(found).collect() == district_summary(kept).collect()
    kept.release()
    assert not [t for t in spark.catalog.listTables() if t.name in kept.tables]

"""Many-to-many links: every level, copies, what is left, and random rosters against plain Python."""

import random
from collections import Counter

from helpers import rosters

from rosterloom.config import MatchConfig
from rosterloom.operators.link import link_rosters
from rosterloom.operators.resolve import LEVELS, resolve, resolved_pairs, unresolved_rows

CFG = MatchConfig()
COLUMNS = {"birth_date": "student_dob", "first_name": "student_first_name", "last_name": "student_last_name",
           "school_code": "school_code4", "case_number": "case_number", "address": "student_address1"}


def resolved(spark, registry, upload):
    found = resolve(link_rosters(*rosters(spark, registry, upload), CFG))
    return resolved_pairs(found).collect(), {side.prefix: unresolved_rows(found, side).collect() for side in CFG.sides}


def said(pairs, left):
    """By the city, which no level compares and which tells the rows of these tests apart."""
    return (sorted((r.level, r.primero_student_city, r.sebt_student_city, r.n_p, r.n_s) for r in pairs),
            sorted((side, r[f"{side}_student_city"], r.copies, r.reason) for side, rows in left.items() for r in rows))


def row(city, key="1", **values):
    return {"pasecureid": key, "student_city": city} | values


def test_keys(spark):
    twin, other = {"student_first_name": "bea"}, {"student_first_name": "bea", "case_number": "c2"}
    blank = {"case_number": " ", "student_address1": None, "student_dob": None}
    registry = [
        row("a1"), row("b1", **twin), row("c1", case_number="c9", student_dob="2014-01-01"),   # all told apart
        *[row("a2", "2")] * 3, row("b2", "2", **other),                                         # copies; the last one left
        row("a3", "3"), row("b3", "3"),                                                         # nothing tells
        row("a4", "4"), row("b4", "4", **other), row("c4", "4", **other, student_address1="9 Elm"),  # one too many
        row("a5", "5", **blank), row("b5", "5", **blank),                                       # missing values
        row("a6", "6"),                                                                         # not many-to-many
    ]
    upload = [
        row("x1"), row("y1", **twin, school_code4="0002"), row("z1", case_number="c9", student_dob="2013-01-01"),
        *[row("x2", "2")] * 2, row("y2", "2", student_first_name="cleo", case_number="c3"),
        row("x3", "3"), row("y3", "3"),
        row("x4", "4"), row("y4", "4", **other),
        row("x5", "5", **blank), row("y5", "5", **blank),
        row("x6", "6"), row("y6", "6"),
    ]
    pairs, left = said(*resolved(spark, registry, upload))
    assert pairs == sorted([(1, "a1", "x1", 1, 1), (2, "b1", "y1", 1, 1), (5, "c1", "z1", 1, 1), (1, "a2", "x2", 3, 2),
                            (6, "b2", "y2", 1, 1), (1, "a4", "x4", 1, 1), (1, "b4", "y4", 1, 1)])
    assert left == sorted([("primero", "c4", 1, "surplus")] + [
        (side, f"{c}{key}", 1, "ambiguous") for key in "35" for side, cs in (("primero", "ab"), ("sebt", "xy")) for c in cs])


def test_empty_rosters(spark):
    assert said(*resolved(spark, [], [])) == ([], [])


def plainly(registry, upload):
    """One key: rows that are each other's only partner, level by level."""
    p, s = Counter(tuple(sorted(r.items())) for r in registry), Counter(tuple(sorted(r.items())) for r in upload)
    pairs, left_p, left_s = [], set(p), set(s)

    def values(r, level):
        out = [dict(r)[COLUMNS[name]].strip().lower() for name in level]
        return tuple(out) if all(out) else None

    for i, level in enumerate(LEVELS, 1):
        partners = {a: [b for b in left_s if values(a, level) is not None and values(a, level) == values(b, level)] for a in left_p}
        for a, found in partners.items():
            if len(found) == 1 and sum(found[0] in other for other in partners.values()) == 1:
                pairs.append((i, dict(a)["student_city"], dict(found[0])["student_city"], p[a], s[found[0]]))
        left_p -= {a for a in left_p if any(dict(a)["student_city"] == x[1] for x in pairs)}
        left_s -= {b for b in left_s if any(dict(b)["student_city"] == x[2] for x in pairs)}
    left = [(side, dict(r)["student_city"], n[r], "ambiguous" if others else "surplus")
            for side, rows, n, others in (("primero", left_p, p, left_s), ("sebt", left_s, s, left_p)) for r in rows]
    return sorted(pairs), sorted(left)


def test_random_keys(spark):
    rng = random.Random(8)
    choices = {"student_dob": "12", "student_first_name": "ab", "student_last_name": "c", "school_code4": "12",
               "case_number": ["", "1", "2", "3"], "student_address1": "xyz"}
    sides, expected = ([], []), ([], [])
    for key in range(60):
        both = []
        for side, city in zip(sides, "ps"):
            rows = [row(f"{city}{key}-{i}", pasecureid=str(key), **{c: rng.choice(v) for c, v in choices.items()})
                    for i in range(rng.randint(2, 6))]
            rows += rng.choices(rows, k=2)
            side += rows
            both.append(rows)
        for out, part in zip(expected, plainly(*both)):
            out += part
    assert said(*resolved(spark, *sides)) == tuple(sorted(x) for x in expected)


def test_many_to_many_keys_are_counted_once(spark, monkeypatch):
    """Both sides look up stored keys; counting them again for each would take the keys of all rows."""
    from rosterloom.operators import resolve as module

    looked_up, lookup = [], module.rows_under
    monkeypatch.setattr(module, "rows_under", lambda link, side, keys: looked_up.append(keys.inputFiles()) or lookup(link, side, keys))
    both = [row("a"), row("b")]
    resolved(spark, both, both)
    assert len(looked_up) == 2 and looked_up[0] == looked_up[1] and "/keys/" in looked_up[0][0]

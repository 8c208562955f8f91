"""Hard negatives against comparing everything with everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom.llm import negatives as N
from rosterloom.llm.negatives import Mining, hard_negatives, integer_rows

SCHEMA = "vec_id bigint, label int, embedding array<double>"
SMALL = Mining(cell_rows=4, block=3, first=1, growth=2, sample=40)


def plain(rows, every=10, how=Mining()):
    """rows: {vec_id: (label, vector)} of those that take part."""
    width = max((len(v) for _, v in rows.values()), default=0)
    q = {i: [math.floor(256 * x) for x in v] + [0] * (width - len(v)) for i, (_, v) in rows.items()}
    out = set()
    for a in (i for i in rows if i % every == 0):
        score = {i: sum(x * y for x, y in zip(q[a], q[i])) for i in rows if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:how.positives]:
            fits = [i for i in order if rows[i][0] != rows[a][0]
                    and how.low * score[p] <= 100 * score[i] <= how.high * score[p]]
            out |= {(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(fits[:how.negatives])}
    return out


def vectors(seed, n, width=8, clusters=6, spread=0.2, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    at = rng.integers(0, clusters, n)
    points = centres[at] + spread * rng.normal(size=(n, width))
    label = np.where(rng.random(n) < 0.7, at % labels, rng.integers(0, labels, n))
    points[n // 2:n // 2 + n // 5] = points[0]
    return {i: (int(c), [float(x) for x in p]) for i, (c, p) in enumerate(zip(label, points))}


def mined(spark, rows, how=Mining(), every=10, schema=SCHEMA):
    frame = spark.createDataFrame([(i, *row) for i, row in rows.items()], schema)
    got = hard_negatives(integer_rows(frame), F.col("vec_id") % every == 0, how).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("seed, width, how", [(1, 8, SMALL), (2, 1, SMALL), (3, 7, Mining()), (4, 8, Mining(cell_rows=2, block=50))])
def test_as_by_brute_force(spark, seed, width, how):
    rows = vectors(seed, 150, width)
    assert mined(spark, rows, how) == plain(rows) != set()


def test_few_positives_and_large_components(spark):
    rows = vectors(7, 40, 3, labels=2)
    rows = {i: (9 if i in (0, 10) else c, [x * 20_000 for x in v]) for i, (c, v) in rows.items()}
    assert mined(spark, rows, SMALL) == plain(rows) != set()


def test_what_takes_no_part(spark):
    rows = vectors(5, 60)
    bad = [(100, None, rows[0][1]), (110, 1, None), (120, 1, [1.0, None] + [0.0] * 6), (130, 1, [float("nan")] * 8),
           (140, 1, [float("inf")] * 8), (None, 1, rows[0][1])]
    short = {200: (1, [0.5]), 201: (2, [])}
    frame = spark.createDataFrame([(i, *row, {"a": 1}, 1) for i, row in (rows | short).items()] + [(*b, None, 2) for b in bad]
                                  + [(3, *rows[3], None, 3)], SCHEMA + ", `a.b` map<string,int>, cell int")
    got = {tuple(r) for r in hard_negatives(integer_rows(frame), F.col("vec_id") % 10 == 0, SMALL).collect()}
    assert got == plain(rows | short)


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, {}) == set()
    assert mined(spark, {i: r for i, r in vectors(1, 9).items() if i}) == set()
    assert mined(spark, {0: (1, []), 1: (1, []), 2: (2, [])}) == {(0, 1, 1, 2, 0, 0)}


def test_cells_come_once_by_falling_bound_and_bounds_hold():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(size=(400, 6))).astype(np.int64)
    words = N.fitted(rows[:, :3], 5), N.fitted(rows[:, 3:], 4)
    at = [N.nearest(part, w) for part, w in zip((rows[:, :3], rows[:, 3:]), words)]
    cell = at[0] * 4 + at[1]
    away = [N.above_lengths(part - w[i]) for part, w, i in zip((rows[:, :3], rows[:, 3:]), words, at)]
    reach = [np.array([a[cell == c].max(initial=0) for c in range(20)]) for a in away]
    grid = N.Grid(6, words, np.bincount(cell, minlength=20), tuple(reach))
    for anchor in rows[:20]:
        seen, last, held = [], None, None
        scores = rows @ anchor
        while True:
            # A round ends now and then, and the next one goes on from what was kept.
            visit = N.Visit(grid, anchor, held, grid.word_reach())
            for _ in range(3):
                if not visit.heap:
                    break
                ahead = visit.best_ahead()
                assert last is None or ahead <= last
                last = ahead
                c, top, bottom = visit.step()
                seen.append(c)
                assert all(bottom <= s <= top <= ahead for s in scores[cell == c])
            held = visit.at
            if not visit.heap:
                break
        assert sorted(seen) == list(range(20))


def test_clustered_vectors_are_not_all_compared():
    """Of tight clusters, an anchor's wanted rows are certified before most cells are seen."""
    rows = np.array([r for _, r in vectors(9, 2000, 16, clusters=40, spread=0.01).values()])
    q = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.int64)
    words = N.fitted(q[:, :8], 16), N.fitted(q[:, 8:], 16)
    at = [N.nearest(part, w) for part, w in zip((q[:, :8], q[:, 8:]), words)]
    cell = at[0] * 16 + at[1]
    away = [N.above_lengths(part - w[i]) for part, w, i in zip((q[:, :8], q[:, 8:]), words, at)]
    reach = tuple(np.array([a[cell == c].max(initial=0) for c in range(256)]) for a in away)
    grid = N.Grid(16, words, np.bincount(cell, minlength=256), reach)
    met = []
    for anchor in q[::100]:
        visit, rows_met = N.Visit(grid, anchor, None, grid.word_reach()), 0
        fifth = np.sort(q @ anchor)[-6]
        while visit.heap and visit.best_ahead() >= fifth:
            rows_met += grid.blocks[visit.step()[0]]
        met.append(rows_met)
    assert np.median(met) < 0.2 * len(q)

import random

import numpy as np
import pandas as pd
import pytest
from helpers import scalar_jaro
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterloom.functions import jaro as jaro_module
from rosterloom.functions.jaro import jaro, jaro_scores
from rosterloom.functions.text import (
    ADDRESS_WORDS, cell_text, id_length_flag, is_filled, standardize_address, text_key, tidy_key,
)


def evaluate(spark, values, *columns, names=("a", "b", "c", "d")):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    schema = ", ".join(f"{n} string" for n in names[: len(rows[0])])
    out = spark.createDataFrame(rows, schema).select(*[c.alias(f"o{i}") for i, c in enumerate(columns)])
    got = [tuple(r) for r in out.collect()]
    return [g[0] for g in got] if len(columns) == 1 else got


def test_tidy_key(spark):
    got = evaluate(spark, ["\t ID1 \r\n", "A  B", "", None, " X"], tidy_key(F.col("a")))
    assert got == ["id1", "a  b", "", None, " x"]


def test_tidy_key_repairs_bytes(spark):
    df = spark.range(1).select(tidy_key(F.expr("cast(X'41FF42' as string)")).alias("o"))
    assert df.first().o == "a�b"


def test_cell_text(spark):
    got = evaluate(spark, ["NA", "", None, "na", "007"], cell_text(F.col("a")),
                   cell_text(F.col("a"), blank_as_null=True))
    assert got == [(None, None), ("", None), ("", None), ("na", "na"), ("007", "007")]


def test_text_key(spark):
    parts = [F.col(c) for c in "abcd"]
    got = evaluate(spark, [("1", None, None, None), ("1", "x", "", "z")], text_key(parts),
                   text_key(parts, keep_missing=False), text_key(parts, separator="|", missing_text="?"))
    assert got == [("1_NA_NA_NA", None, "1|?|?|?"), ("1_x__z", "1_x__z", "1|x||z")]


def test_is_filled_is_never_null(spark):
    assert evaluate(spark, ["x", "", None], is_filled(F.col("a"))) == [True, False, False]


def test_id_length_flag(spark):
    got = evaluate(spark, [None, "0123456789", "012345678", "", "ññññññññññ"], id_length_flag(F.col("a")))
    assert got == [None, "TRUE", "9", "0", "TRUE"]


ADDRESSES = {
    "12 Main Street.": "12 main st",
    "10 Broad Road": "10 broad rd",
    "10 Broadway Boulevard": "10 broadway blvd",
    "Street street STREET": "st st st",
    "1 Avenue Drive Lane Court Place": "1 ave dr ln ct pl",
    "1 streets roadside": "1 streets roadside",
    " 5  Oak   St. ": "5  oak   st",
    "P.O. Box 1": "po box 1",
    "...": "",
    "a-road,street": "a-rd,st",
    "road_x road": "road_x rd",
    "éstreet street": "éstreet st",
    "": "",
}


def test_standardize_address(spark):
    got = evaluate(spark, list(ADDRESSES) + [None], standardize_address(F.col("a")))
    assert got == list(ADDRESSES.values()) + [None]


def test_one_pattern_equals_one_pass_per_word(spark):
    rng = random.Random(1)
    bits = [w for pair in ADDRESS_WORDS for w in pair] + ["oak", ".", "-", " ", "s", "e", "12"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "", ".", " "]) for _ in range(rng.randint(1, 7)))
             for _ in range(500)]
    step = F.lower(F.btrim(F.col("a"), F.lit(" \t\r\n")))
    for word, short in ADDRESS_WORDS:
        step = F.regexp_replace(step, rf"\b{word}\b", short)
    for one, many in evaluate(spark, texts, standardize_address(F.col("a")), F.replace(step, F.lit("."), F.lit(""))):
        assert one == many


def test_standardizing_twice_changes_nothing(spark):
    once = standardize_address(F.col("a"))
    for one, two in evaluate(spark, list(ADDRESSES), once, standardize_address(once)):
        if one == one.strip(" "):
            assert one == two


VECTORS = [("martha", "marhta", 0.9444), ("dwayne", "duane", 0.8222), ("dixon", "dicksonx", 0.7667),
           ("12 oak st", "12 oak street", 0.8974), ("", "", 1.0), ("a", "", 0.0), ("", "a", 0.0),
           ("abc", "abc", 1.0), ("abc", "xyz", 0.0), ("josé", "jose", 0.8333), ("😀ab", "😀ab", 1.0)]


def test_jaro_vectors(spark):
    got = evaluate(spark, [(a, b) for a, b, _ in VECTORS], jaro(F.col("a"), F.col("b")))
    assert got == pytest.approx([v for *_, v in VECTORS], abs=5e-5)


def test_jaro_of_nulls(spark):
    assert evaluate(spark, [(None, "a"), ("a", None), (None, None)], jaro(F.col("a"), F.col("b"))) == [None] * 3


TEXT = st.text(alphabet="aab1 é😀", max_size=14)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), TEXT), st.one_of(st.none(), TEXT)), max_size=40))
def test_batches_score_as_single_pairs(pairs):
    got = jaro_scores(pd.Series([a for a, _ in pairs], dtype=object), pd.Series([b for _, b in pairs], dtype=object))
    for (a, b), score in zip(pairs, got):
        if a is None or b is None:
            assert np.isnan(score)
        else:
            assert score == scalar_jaro(a, b)
            assert 0 <= score <= 1
            assert jaro_scores(pd.Series([a]), pd.Series([a]))[0] == 1.0


def test_texts_longer_than_a_batch(monkeypatch):
    monkeypatch.setattr(jaro_module, "_CELLS", 64)
    rng = random.Random(2)
    pairs = [tuple("".join(rng.choice("abc") for _ in range(rng.randint(0, 150))) for _ in "ab") for _ in range(60)]
    got = jaro_scores(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert list(got) == [scalar_jaro(a, b) for a, b in pairs]


def test_same_scores_as_duckdb():
    import duckdb

    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("abcde 12") for _ in range(rng.randint(1, 20))) for _ in "ab")
             for _ in range(3000)]
    frame = pd.DataFrame(pairs, columns=["a", "b"])
    theirs = duckdb.sql("SELECT jaro_similarity(a, b) FROM frame").fetchall()
    assert list(jaro_scores(frame.a, frame.b)) == [s for s, in theirs]

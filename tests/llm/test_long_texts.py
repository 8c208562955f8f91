"""Very long texts in bounded memory, with the results of a plain reading of the whole."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from rosterloom.llm import line_rules, toxicity

TEXTS = ["", " ", "a", "  a  b \n", "Über-GROẞ İ x", "\n\nq\r\n\tz ", "👍🏽 ok…. x", "abc " * 40, "x" * 300, "日本語 テキスト。",
         " ".join(random.Random(4).choices(["the", "Cat", "  ", "\n", "sat!", "ΟΔΟΣ"], k=400))]


def plain_places(text):
    """Every n-gram as a string, hashed character by character."""
    text = " " + re.sub(r"[\x00-\x20]+", " ", text.lower()) + " "
    out = set()
    for n in toxicity.SIZES:
        for gram in {text[i:i + n] for i in range(len(text) - n + 1)}:
            h = ord(gram[0]) * 0x9E3779B1 % 2 ** 32
            for c in gram[1:]:
                h = ((h ^ h >> 15) * 0x85EBCA77 + ord(c) * 0x9E3779B1) % 2 ** 32
            out.add((h ^ h >> 16) * 0xC2B2AE3D % 2 ** 32 >> 12)
    return out


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 18])
def test_places_and_scores_by_plain_ngrams(monkeypatch, window):
    monkeypatch.setattr(toxicity, "WINDOW", window)
    weights = np.random.default_rng(1).normal(size=toxicity.PLACES + 1).astype(np.float32)
    stamp = toxicity.new_stamp()
    for text in TEXTS:
        # A word of capitals ends in another sigma than it has alone; borders fall at white space where they can.
        found, want = toxicity.places(text, stamp), plain_places(text)
        if window > 1 or "Σ" not in text:
            assert len(found) == len(set(found.tolist())) and set(found.tolist()) == want
            z = sum(float(weights[i]) for i in want) / max(len(want), 1) ** 0.5 + float(weights[-1])
            assert toxicity.score(text, weights, stamp) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    kept = [x for x in text.split("\n") if not (n := len(re.findall(r"[^\x20\x09-\x0D]+", x))) or not line_rules.Rules().failed(x, n)]
    return len(words), len(inside), len(lines) - len(set(lines)), "\n".join(kept)


@pytest.mark.parametrize("block", [1, 5, 1 << 20])
def test_line_rules_by_plain_counts(monkeypatch, block):
    monkeypatch.setattr(line_rules, "BLOCK", block)
    rng = random.Random(5)
    more = ["".join(rng.choices(["a ", "b ", "c ", "\n", "# ", "click here\n", "x y "], k=rng.randint(1, 300))) for _ in range(60)]
    for text in TEXTS + more:
        found = line_rules.judged(text)
        assert (found["n_words"], found["n_repeat_words"], found["n_dup_lines"], found["clean_text"]) == plain_counts(text)
        assert line_rules.judged(text, with_text=False) == found | {"clean_text": None}


def test_memory_does_not_grow_with_ngrams_and_windows():
    words = [f"w{i}" for i in range(5000)]
    text = " ".join(random.Random(6).choices(words, k=1_500_000)) + "\n" + "one more line\n" * 1000
    for run, most in ((lambda: toxicity.places(text, toxicity.new_stamp()), 4), (lambda: line_rules.judged(text), 12)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(text) + 64e6

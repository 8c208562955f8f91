"""Each stage of the pipeline on its own input against a plain version, and op2 and op9 as queries."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import brute_targets, brute_weighted, class_ids, plain_rules

import corpus_pipeline
from rosterloom.llm import line_rules
from rosterloom.llm.pieces import processor
from rosterloom.llm.queries import QUERIES
from rosterloom.llm.tables import kept_as, table
from rosterloom.llm.vocabularies import default_path
from rosterloom.workspace import work_folder

SPACES = " \t\n\v\f\r"


def words_of(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_fault(line):
    n, rules = len(words_of(line)), line_rules.Rules()
    count = lambda marks: sum(c in marks for c in line)
    letters, capitals = sum(c.isalpha() for c in line), sum(c.isupper() for c in line)
    parted, lower = count("|»›•·") > 0.2 * n, line.lower()
    if count("#*$%&|<>") > 0.2 * n:
        return "navigation" if parted else "punctuation"
    if n >= 3 and count("!") > 0.3 * n or n >= 5 and (
            capitals > 0.6 * letters or line.upper() == line and line.lower() != line):
        return "punctuation"
    if parted or n <= 6 and 2 * sum(w.strip(".,:;!?") in line_rules.MENU for w in lower.split()) > n:
        return "navigation"
    return "boilerplate" if n <= rules.boilerplate_words and any(p in lower for p in line_rules.BOILERPLATE) else None


def plain_quality(text):
    """Counts of faults, words lost, whether the text is kept, and the text without its faulty lines."""
    text = text or ""
    lines = [(line, plain_fault(line) if words_of(line) else None) for line in text.split("\n")]
    lost = sum(len(words_of(line)) for line, why in lines if why)
    n_words, *_, failed = plain_rules(text)
    return (Counter(why for _, why in lines if why), lost, not failed and lost <= 0.3 * n_words,
            "\n".join(line for line, why in lines if not why))


def counted(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Per stage its input and its output, as rows."""
    docs, out = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = kept_as(stage(spark, docs, sf_dir), work_folder(spark, "test-stages"))
        out[name] = docs.collect(), after.collect()
        docs = after
    return out


def test_toxicity_stage(spark, sf_dir, stages):
    before, after = stages["toxicity"]
    toxic = {r.doc_id for r in QUERIES["op4_toxicity"](spark, sf_dir).filter("predicted = 1").collect()}
    assert after and counted(after) == counted(r for r in before if r.doc_id not in toxic)


def test_quality_stage(stages):
    before, after = stages["quality rules"]
    want = []
    for row in before:
        _, _, kept, text = plain_quality(row.text)
        if kept:
            changed = {"text": text} | ({"n_chars": len(text)} if "n_chars" in row else {})
            want.append(tuple(changed.get(c, row[c]) for c in row.__fields__))
    assert want and len(want) < len(before) and counted(after) == Counter(want)


def test_near_dedup_stage(stages):
    before, after = stages["minhash near-dedup"]
    rows = [(r.doc_id, r.text) for r in before]
    assert len({i for i, _ in rows}) == len(rows)
    want = [r for r, least in zip(before, class_ids(rows, brute_weighted(rows))) if r.doc_id == least]
    assert want and len(want) < len(before) and counted(after) == counted(want)


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(words_of(r.text or ""))
    targets, want = brute_targets(sizes), Counter()
    for r in before:
        rate = targets[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        draw = int(hashlib.md5(f"10:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2 ** 52
        copies = math.floor(rate + 1e-9)
        want[tuple(r)] += copies + (draw < rate - copies)
    assert counted(after) == +want


def decodes(before, after):
    model = processor(default_path("piece_bpe_32k.model"))
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in after)
    marked = lambda text: (text or "").replace("▁", " ")  # noqa: E731  the library's decoder makes it a space
    assert Counter((r.doc_id, marked(model.decode(r.pieces))) for r in after) == Counter(
        (r.doc_id, marked(r.text)) for r in before)


def test_sentencepiece_stage(stages):
    decodes(*stages["sentencepiece"])


def test_op9(spark, sf_dir):
    decodes(table(spark, sf_dir, "documents").collect(), QUERIES["op9_sentencepiece"](spark, sf_dir).collect())


def test_op2(spark, sf_dir):
    texts = Counter()
    for r in table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        faults, lost, kept, _ = plain_quality(r.text)
        texts[(r.doc_id, *plain_rules(r.text), lost, *(faults[x] for x in ("punctuation", "navigation", "boilerplate")), kept)] += 1
    got = QUERIES["op2_quality_rules"](spark, sf_dir).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words",
        "n_punctuation", "n_navigation", "n_boilerplate", "kept")
    assert counted(got.collect()) == texts

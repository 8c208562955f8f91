"""Quality rules, lines first: lines that break a rule go, then documents that lost too much.

Each line is judged alone: by its marks (symbols, exclamation marks, capitals), as navigation
(separated items, menu words) and as boilerplate (fixed phrases). A document is rejected by the
base rules (too few words, too much repetition) or if the lines that went hold more than a
share of its words.

Defined results: a word is a stretch without the six ASCII white-space characters. A null or empty
text has no words, is rejected and stays empty. Lines are what stands between line feeds; a
line without words is kept and counts for nothing. Each row is judged alone, so repeated rows
get the same result; a very long text takes some 8 bytes a word besides itself; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rosterloom.llm.tables import small_batches, unused

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
BLOCK = 1 << 20
_SPACE = re.compile(f"[{SPACES}]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
MENU = frozenset("home about contact login logout register search menu sitemap next previous back top "
                 "share tweet print subscribe newsletter archive categories tags comments".split())
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "we use cookies", "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
    "click here", "read more", "sign up", "log in to", "subscribe to our", "share this",
    "powered by", "copyright (c)", "copyright ©", "page not found", "back to top",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50  # of the words may be in windows of three that repeat
    symbols_per_word: float = 0.2
    bangs_per_word: float = 0.3
    capital_share: float = 0.6  # of the letters of a line of at least `capital_words` words
    capital_words: int = 5
    separators_per_word: float = 0.2
    separators: str = "|»›•·"
    menu_words: int = 6  # a line of at most so many words is a menu if half are menu words
    boilerplate_words: int = 20  # boilerplate phrases count in lines of at most so many words
    max_lost: float = 0.3

    def failed(self, line: str, n_words: int) -> str | None:
        """The rule that a line with words breaks."""
        if sum(map(line.count, SYMBOLS)) > self.symbols_per_word * n_words:
            separators = sum(map(line.count, self.separators))
            return "navigation" if separators > self.separators_per_word * n_words else "punctuation"
        if line.count("!") > self.bangs_per_word * n_words and n_words >= 3:
            return "punctuation"
        if n_words >= self.capital_words and line.upper() == line != line.lower():
            return "punctuation"
        if n_words >= self.capital_words and sum(map(str.isupper, line)) > self.capital_share * sum(map(str.isalpha, line)):
            return "punctuation"
        if sum(map(line.count, self.separators)) > self.separators_per_word * n_words:
            return "navigation"
        if n_words <= self.boilerplate_words:
            lower = line.lower()
            if n_words <= self.menu_words and 2 * sum(w.strip(".,:;!?") in MENU for w in lower.split()) > n_words:
                return "navigation"
            if _BOILERPLATE.search(lower):
                return "boilerplate"
        return None


def repeated_words(words: array) -> int:
    """Words within windows of three words that are found twice or more; the words are given as 64-bit hashes."""
    n = len(words) - 2
    if n < 2:
        return 0
    h, windows = np.frombuffer(words, np.uint64), np.empty(n, np.uint64)
    for i in range(0, n, BLOCK):
        j = min(i + BLOCK, n)
        x = h[i:j]
        for shift in (1, 2):
            x = x * _ODD
            x = (x ^ (x >> np.uint64(32))) + h[i + shift:j + shift]
        windows[i:j] = x
    several = np.sort(windows)
    several = several[1:][several[1:] == several[:-1]]
    if not len(several):
        return 0
    inside = np.zeros(n + 2, bool)
    for i in range(0, n, BLOCK):
        part = windows[i:i + BLOCK]
        hit = several[np.minimum(np.searchsorted(several, part), len(several) - 1)] == part
        for shift in range(3):
            inside[i + shift:i + shift + len(part)] |= hit
    return int(inside.sum())


def _lines(text: str) -> Iterator[tuple[int, int]]:
    start = 0
    while (end := text.find("\n", start)) >= 0:
        yield start, end
        start = end + 1
    yield start, len(text)


def _words(line: str) -> Iterator[list[bytes]]:
    """The words of a line, those of about BLOCK characters at a time."""
    at = 0
    while len(line) - at > BLOCK:
        found = _SPACE.search(line, at + BLOCK)
        end = found.start() if found else len(line)
        yield line[at:end].encode("utf-8", "surrogatepass").split()
        at = end
    yield (line[at:] if at else line).encode("utf-8", "surrogatepass").split()


def judged(text: str | None, rules: Rules = Rules(), with_text: bool = True) -> dict:
    """What is found in one text, the text without failed lines, and the verdict.

    Words and lines are kept as 64-bit hashes, what stays of the text as the ends of its stretches.
    """
    text = text or ""
    words, lines, stretches, lost = array("q"), array("q"), [], 0
    fails = Counter()
    for start, end in _lines(text):
        line, before = text[start:end], len(words)
        for some in _words(line):
            words.extend(map(hash, some))
        n = len(words) - before
        if n:
            lines.append(hash(line))
            if why := rules.failed(line, n):
                fails[why] += 1
                lost += n
                continue
        if stretches and stretches[-1][1] == start - 1:
            stretches[-1] = stretches[-1][0], end
        else:
            stretches.append((start, end))
    repeats, n_words = repeated_words(words), len(words)
    base_failed = n_words < rules.min_words or 100 * repeats > rules.max_repeat_percent * n_words
    return {
        "n_words": n_words, "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(np.unique(np.frombuffer(lines, np.int64))) if lines else 0,
        "n_repeat_words": repeats, "base_failed": base_failed,
        "kept": not base_failed and lost <= rules.max_lost * n_words,
        "lost_words": lost, "n_punctuation": fails["punctuation"], "n_navigation": fails["navigation"],
        "n_boilerplate": fails["boilerplate"],
        "clean_text": "\n".join(text[a:b] for a, b in stretches) if with_text else None,
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words",
           "n_punctuation", "n_navigation", "n_boilerplate")
_TYPE = "struct<" + ", ".join(f"{c}: bigint" for c in _COUNTS) + ", base_failed: boolean, kept: boolean, clean_text: string>"


def line_rules(text: Column, rules: Rules = Rules(), with_text: bool = True) -> Column:
    """A struct of all that `judged` says of a text; without the clean text if not wanted."""
    returns = _TYPE if with_text else _TYPE.replace(", clean_text: string", "")
    fields = [(c, pa.int64()) for c in _COUNTS] + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
    fields += [("clean_text", pa.string())] * with_text

    @arrow_udf(returns)
    def run(texts: pa.Array) -> pa.Array:
        found = [judged(t, rules, with_text) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[c] for r in found], t) for c, t in fields],
                                          [c for c, _ in fields])

    # Said to be not deterministic, so that a filter on it does not have it computed twice.
    return run.asNondeterministic()(text)


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id and all counts and verdicts, one row per row of (doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", line_rules(F.col("text"), rules, False).alias("found")).select("doc_id", "found.*")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, without their failed lines. n_chars, where there is one,
    follows the text; all other columns stay."""
    small_batches(docs.sparkSession)
    found = unused("found", docs)
    columns = {"text": F.col(f"{found}.clean_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(f"{found}.clean_text").cast(docs.schema["n_chars"].dataType)
    return (docs.withColumn(found, line_rules(F.col("text"), rules)).filter(F.col(f"{found}.kept"))
            .select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]))

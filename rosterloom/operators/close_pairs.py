"""Pairs of close but unequal texts under one key, found without comparing all with all.

Two texts of lengths a and b reach a Jaro score of t only if they share at least
M = (3t − 1)·a·b / (a + b) characters, each counted as often as it occurs. So a text of length
a may miss a − M of its characters. Put the characters of all texts of a key in one order, the
rare ones of that key first. Then the first g characters that two close texts share are among
the first (a − M + g) of the one and (b − M + g) of the other: they have a set of g
characters in common that is a subset of both short beginnings. All subsets of g become
search keys, by hash. The larger g, the fewer texts share a subset by chance; it is chosen per pair of
lengths such that a text has at most about 64 subsets.

The order comes from the texts: under a key whose addresses are alike, what they all share comes
last and hardly ever becomes part of a subset. What meets is tested by signatures and then
scored. Nothing is missed and nothing is capped; search keys shared by many texts are sliced by the
product of both sides, measured.
"""

from __future__ import annotations

import hashlib
import math
import sys
from bisect import bisect_right
from collections import Counter
from dataclasses import replace
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.config import MatchConfig
from rosterloom.functions.jaro import jaro_where
from rosterloom.operators.link import KEY
from rosterloom.operators.skew import ROW, HotKeys
from rosterloom.workspace import work_folder

# Subsets of a text for one length of partners, at most about.
SUBSETS = 64
# Characters of a key whose order is listed, the most frequent ones; all others are rarer than these.
LISTED = 256
# Lengths up to this are told apart one by one, greater ones in steps of 5 %.
_SHORT, _STEP = 64, 1.05


@lru_cache(maxsize=1)
def _borders() -> list[int]:
    """The least length of every class above the short ones."""
    out = [_SHORT + 1]
    while out[-1] < 1 << 31:
        out.append(max(int(out[-1] * _STEP), out[-1] + 1))
    return out


def length_class(length: int) -> int:
    return length if length <= _SHORT else _SHORT + bisect_right(_borders(), length)


def class_lengths(cls: int) -> tuple[int, int]:
    """The least and the greatest length of a class."""
    if cls <= _SHORT:
        return cls, cls
    least = _borders()[cls - _SHORT - 1]
    return least, _borders()[cls - _SHORT] - 1


def least_common(a: int, b: int, threshold: float) -> int:
    """Characters two texts of these lengths must share to reach the threshold.

    With m matching characters Jaro is at most (m/a + m/b + 1) / 3.
    """
    return max(math.ceil((3 * threshold - 1) * a * b / (a + b) - 1e-9), 1)


@lru_cache(maxsize=1 << 16)
def subset_size(own: int, other: int, threshold: float) -> int:
    """How many characters a subset has for two classes of lengths, the same from both sides; 0 if no texts
    of theirs can reach the threshold."""
    (a, most_a), (b, most_b) = class_lengths(own), class_lengths(other)
    # Jaro is at most (2 + shorter/longer) / 3.
    ratio = 3 * threshold - 2
    if most_a < ratio * b - 1e-9 or most_b < ratio * a - 1e-9:
        return 0
    missing = max(most_a - least_common(most_a, b, threshold), most_b - least_common(a, most_b, threshold))
    most, size = least_common(a, b, threshold), 1
    while size < most and math.comb(missing + size + 1, size + 1) <= SUBSETS:
        size += 1
    return size


def numbered(text: str) -> list[str]:
    """The characters of a text, numbered by occurrence: 'abba' → a1 b1 b2 a2."""
    seen: Counter = Counter()
    out = []
    for c in text:
        seen[c] += 1
        out.append(f"{c}{seen[c]}")
    return out


def search_keys(key: bytes, text: str, rank: dict[str, int], others: list[int], threshold: float, first: bool) -> set[bytes]:
    """The search keys of one text for partners of the given classes. `first` says on which side the text is."""
    # Characters that are not listed are the rarest.
    ordered = sorted(numbered(text), key=lambda c: (-rank.get(c, 1 << 30), c))
    parts, own, out = [c.encode() + b"\0" for c in ordered], length_class(len(text)), set()
    for other in others:
        size = subset_size(own, other, threshold)
        if size:
            keep = len(text) - least_common(len(text), class_lengths(other)[0], threshold) + size
            pair = f"{own}:{other}:" if first else f"{other}:{own}:"
            head = hashlib.blake2b(key + pair.encode(), digest_size=8)
            for subset in combinations(parts[:keep], size):
                done = head.copy()
                done.update(b"".join(subset))
                out.add(done.digest())
    return out


def _characters(batches):
    """Per key: how many texts of a batch have a character, and the lengths on each side."""
    for batch in batches:
        counts: Counter = Counter()
        for key, side, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for c in numbered(text):
                counts[key, "", c] += 1
            counts[key, side, str(length_class(len(text)))] += 1
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))],
            [KEY, "side", "what", "n"])


def _orders(texts: DataFrame) -> DataFrame:
    """Per key: its listed characters, the most frequent first, and the classes of lengths of both sides."""
    counted = texts.select(KEY, "side", "value").mapInArrow(
        _characters, f"{KEY} string, side string, what string, n bigint")
    counts = counted.groupBy(KEY, "side", "what").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("n"), "what"))
    listed = counts.filter("side = ''").withColumn("place", place).filter(F.col("place") <= LISTED)
    common = listed.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("place", "what"))).alias("c"))
    classes = counts.filter("side <> ''").groupBy(KEY).agg(*[
        F.collect_list(F.when(F.col("side") == side, F.col("what").cast("int"))).alias(f"{side}_classes") for side in "ps"])
    return common.join(classes, KEY).select(KEY, F.col("c.what").alias("common"), "p_classes", "s_classes")


def _keyed(threshold: float):
    def run(batches):
        known, rank = None, {}
        for batch in batches:
            ids, sides, found = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("id", KEY, "side", "value", "common", "others"))
            for number, key, side, text, common, others in zip(*columns):
                if key != known:
                    known, rank = key, {c: i for i, c in enumerate(common)}
                for k in search_keys(key.encode(), text, rank, others, threshold, side == "p"):
                    ids.append(number)
                    sides.append(side)
                    found.append(int.from_bytes(k, "big", signed=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sides, pa.string()), pa.array(found, pa.int64())], ["id", "side", "k"])

    return run


def _bits(letters: Column, word: int) -> Column:
    """64 bits of a signature: one bit, by hash, for each numbered character."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(128))
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda bits, c: F.when(
        F.floor(bit(c) / 64) == word,
        bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit(c) % 64).cast("int")))
    ).otherwise(bits))


def _with_signature(values: DataFrame) -> DataFrame:
    letters = F.array_sort(F.split("value", ""))
    names = F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))
    return values.withColumns({"bits0": _bits(names, 0), "bits1": _bits(names, 1)})


def _alike(threshold: float) -> Column:
    """The bits that differ are at most the characters not shared."""
    a, b = F.length("p_value"), F.length("s_value")
    least = F.ceil((3 * threshold - 1) * a * b / (a + b) - 1e-9)
    apart = sum((F.bit_count(F.col(f"p_bits{w}").bitwiseXOR(F.col(f"s_bits{w}"))) for w in (0, 1)), F.lit(0))
    return apart <= a + b - 2 * least


def candidates(pv: DataFrame, sv: DataFrame, cfg: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """The texts of both sides, stored and numbered, and the pairs of numbers that share a search key, each once.

    `pv` and `sv` have the key and a value, each value once; other columns stay with the texts.
    """
    spark, t, limits = pv.sparkSession, cfg.address_threshold, cfg.limits
    folder = work_folder(spark, "close")
    both = pv.withColumn("side", F.lit("p")).unionByName(sv.withColumn("side", F.lit("s")), allowMissingColumns=True)
    signed = _with_signature(both.filter(F.length("value") > 0)).withColumn("id", F.monotonically_increasing_id())
    signed.write.parquet(f"{folder}/texts")
    texts = spark.read.schema(signed.schema).parquet(f"{folder}/texts")
    # Few bytes, much work: a task each for all cores. Nothing is joined by this partitioning.
    spread = texts.select("id", KEY, "side", "value").join(_orders(texts), KEY).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    others = F.when(F.col("side") == "p", F.col("s_classes")).otherwise(F.col("p_classes")).alias("others")
    keys = spread.select("id", KEY, "side", "value", "common", others).mapInArrow(_keyed(t), "id bigint, side string, k bigint")
    keys.write.parquet(f"{folder}/keys")
    keys = spark.read.schema(keys.schema).parquet(f"{folder}/keys")
    p, s = (keys.filter(F.col("side") == side).select("k", F.col("id").alias(f"{side}_id"), F.col("id").alias(ROW))
            for side in "ps")
    # A key has no more pairs than there are pairs of texts. Pairs of two numbers take no time to put together: no products.
    limits = replace(limits, cross_keys=0)
    n, m = texts.agg(F.count_if(F.col("side") == "p"), F.count_if(F.col("side") == "s")).first()
    hot = HotKeys.find([(p, ["k"]), (s, ["k"])], limits) if n * m > limits.slice_pairs else HotKeys(limits)
    if not hot:
        p, s = p.drop(ROW), s.drop(ROW)
    return texts, hot.join_pairs(p, s, "k").select("p_id", "s_id").distinct()


def close_pairs(pv: DataFrame, sv: DataFrame, cfg: MatchConfig) -> DataFrame:
    """The pairs of unequal values of one key that reach the threshold, with the other columns of both sides."""
    texts, pairs = candidates(pv, sv, cfg)
    for side, own in (("p", pv), ("s", sv)):
        kept = texts.filter(F.col("side") == side).select("id", "bits0", "bits1", *own.columns)
        pairs = pairs.join(kept.withColumnsRenamed({c: f"{side}_{c}" for c in (KEY, "id", "value", "bits0", "bits1")}),
                           f"{side}_id")
    # Search keys are hashes: what meets by a collision of two keys is no pair.
    unequal = (F.col("p_value") != F.col("s_value")) & (F.col(f"p_{KEY}") == F.col(f"s_{KEY}"))
    score = jaro_where(unequal, F.col("s_value"), F.col("p_value"))
    return pairs.filter(unequal & _alike(cfg.address_threshold)).filter(score >= cfg.address_threshold)


# The code of this module goes along with its functions: executors do not need the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

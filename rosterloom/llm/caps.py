"""Near-duplicate vectors by spherical caps: filters from structured random product codes.

Vectors are turned by a random rotation and cut into blocks; each block has its random unit
codewords, and every choice of one codeword per block is a filter direction. A vector is in all
filters whose direction it is close to (its inner product exceeds a quantile). These are listed by
list decoding: block after block, leaving choices that cannot exceed it any more. There are
several such codes, each with its own rotation, since one alone may serve a vector badly. How often a
pair of the least cosine shares no filter of a code is measured for the number and length of the
vectors, and there are so many codes that it shares none of all with a chance of at most `miss`,
whatever the number. Vectors are joined on filters, and every pair within one is verified by its
cosine in double precision.

Filters grow in number with the vectors, so that one holds about `load` of vectors that are not
alike, and each vector is in about `lists` of each code. A filter with more than `tile` vectors is cut into
slices, and tasks get two slices each: no pair is left out. A pair that shares several filters
counts in the first of them. What leaves a task is a number per vector, and enough links to
connect what is connected; pairs are never rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing. Vectors of different lengths are never compared. Equal vectors are one class, compared once; they link with
each other. A null id takes part like any other; ids of components are the smallest that are not
null. Rows with one id count one by one. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.graph import components
from rosterloom.llm.tables import kept_as, small_batches
from rosterloom.workspace import work_folder


TURN, LENGTH = 34, 44  # the bits of a filter's number at which its rotation and its length begin
PAIRS = 500
MOST_TURNS = 64


@dataclass(frozen=True)
class Caps:
    cosine: float = 0.95
    load: int = 128
    rotations: int = 8  # at least
    miss: float = 1e-5
    lists: int = 6
    tile: int = 2048
    seed: int = 5


@dataclass(frozen=True)
class Code:
    """The filters of one rotation, for vectors of one length."""
    rotation: np.ndarray
    blocks: tuple[np.ndarray, ...]  # per block its codewords, times 1 / sqrt(number of blocks)
    bound: float

    @staticmethod
    def of(length: int, n: int, turn: int, how: Caps) -> "Code":
        share = min(how.load / max(n, 1), 0.2)
        filters = how.lists / share
        m = min(max(2, math.ceil(math.log(filters, 256))), length)
        size = math.ceil(filters ** (1 / m))
        rng = np.random.default_rng([how.seed, length, m, size, turn])
        rotation = np.linalg.qr(rng.normal(size=(length, length)))[0]
        blocks = []
        for part in np.array_split(np.arange(length), m):
            words = rng.normal(size=(size, len(part)))
            blocks.append(words / np.linalg.norm(words, axis=1, keepdims=True) / math.sqrt(m))
        return Code(rotation, tuple(blocks), cap_bound(length, share))

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) of all vectors and the filters they exceed; at least their best one."""
        turned = unit @ self.rotation
        parts = np.array_split(turned, len(self.blocks), axis=1)
        products = [p @ words.T for p, words in zip(parts, self.blocks)]
        best = np.cumsum([p.max(axis=1) for p in reversed(products)], axis=0)[::-1]
        rest = np.vstack([best[1:], np.zeros(len(unit))])  # the most that later blocks can add
        bound = np.minimum(self.bound, best[0] - 1e-12)
        row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for product, more in zip(products, rest):
            sums = total[:, None] + product[row]
            at, word = np.nonzero(sums + more[row, None] >= bound[row, None])
            total = sums[at, word]
            code = code[at] * product.shape[1] + word
            row = row[at]
        return row, code


def cap_bound(length: int, share: float) -> float:
    """The cosine that a random direction exceeds with probability `share`: the share of the
    sphere's surface in a cap, its density proportional to (1 - t^2) ^ ((length - 3) / 2)."""
    if length < 3:
        return math.cos(math.pi * share) if length == 2 else 0.0
    t = np.linspace(-1, 1, 400_001)
    area = np.cumsum((1 - t * t) ** ((length - 3) / 2))
    return float(t[np.searchsorted(area, (1 - share) * area[-1])])


def least_pairs(length: int, count: int, how: Caps, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors whose cosine is the least that counts."""
    x, y = np.random.default_rng([how.seed, length, seed]).normal(size=(2, count, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, how.cosine * x + math.sqrt(1 - how.cosine ** 2) * y


def apart(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], count: int) -> int:
    """Of so many pairs, given by the (vector, filter) of their sides: those that share no filter."""
    rows, found = (np.concatenate(x) for x in zip(first, second))
    side = np.repeat([0, 1], [len(first[0]), len(second[0])])
    order = np.lexsort((side, found, rows))
    rows, found = rows[order], found[order]
    both = (rows[1:] == rows[:-1]) & (found[1:] == found[:-1])
    return count - len(np.unique(rows[1:][both]))


@lru_cache(maxsize=1 << 16)
def planned(length: int, n: int, how: Caps) -> tuple[int, int]:
    """The number of vectors to make codes for, and the number of codes.

    Rotations are independent, so a pair is missed by all with the chance of one to the power of
    their number. That of one is taken three standard errors above what is measured. Where filters
    are so narrow that it takes too many codes (few dimensions), they are made wider.
    """
    if length < 4:
        n = min(n, 10_000)  # few directions differ; more filters are copies
    if length == 1:
        return n, how.rotations  # one sign, the same filters
    x, y = least_pairs(length, PAIRS, how)
    trials = PAIRS * how.rotations
    while True:
        codes = (Code.of(length, n, turn, how) for turn in range(how.rotations))
        one = sum(apart(code.filters(x), code.filters(y), PAIRS) for code in codes) / trials
        one += 3 * math.sqrt(max(one * (1 - one), 1 / trials) / trials)
        turns = math.ceil(math.log(how.miss) / math.log(one)) if one < 1 else MOST_TURNS + 1
        if turns <= MOST_TURNS:
            return n, max(how.rotations, turns)
        if n <= how.load:
            raise ValueError(f"no filters that find pairs at a cosine of {how.cosine}")
        n //= 4


class Codes:
    """All codes that a task has needed."""

    def __init__(self, n: int, how: Caps, kind=np.float64):
        self.n, self.how, self.kind, self.known = n, how, kind, {}

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) for vectors of one length, ordered by vector."""
        length = unit.shape[1]
        if length not in self.known:
            n, turns = planned(length, self.n, self.how)
            self.known[length] = [Code.of(length, n, turn, self.how) for turn in range(turns)]
        rows, found = [], []
        for turn, code in enumerate(self.known[length]):
            row, filter_ = code.filters(unit)
            rows.append(row)
            found.append(filter_ + (turn << TURN) + (length << LENGTH))
        row, filter_ = np.concatenate(rows), np.concatenate(found)
        order = np.argsort(row, kind="stable")
        return row[order], filter_[order]


def _usable(batches):
    """vec_id, key (null if the vector links with nothing), length, and the vector's own bytes."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        narrow = vectors.type.value_type == pa.float32()
        keys, lengths, raw = [], [], []
        values = vectors.flatten().cast(pa.float64())
        gaps = pc.is_null(values).to_numpy(zero_copy_only=False) if values.null_count else None
        flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        for start, end in zip(ends - sizes, ends):
            x = flat[start:end]
            if end > start and np.isfinite(x).all() and x.any() and (gaps is None or not gaps[start:end].any()):
                x = x + 0.0  # no negative zeros
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                raw.append((x.astype(np.float32) if narrow else x).tobytes())
            else:
                raw.append(None)
                keys.append(None)
            lengths.append(int(end - start))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(keys, pa.binary()), pa.array(lengths, pa.int32()), pa.array(raw, pa.binary())],
            ["vec_id", "key", "length", "vector"])


def _units(raw: list[bytes], kind) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def memberships(classes: DataFrame, n: int, how: Caps, kind=np.float64) -> DataFrame:
    """(filter, key, weight, vector): each class once per filter that it is in."""

    def run(batches):
        codes = Codes(n, how)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = pa.Table.from_batches([batch.slice(at, 512)])
                lengths = part["length"].to_numpy()
                for length in np.unique(lengths).tolist():
                    some = part.filter(pa.array(lengths == length))
                    row, found = codes.filters(_units(some["vector"].to_pylist(), kind))
                    pick = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found), *[some[c].combine_chunks().take(pick) for c in ("key", "weight", "vector")]],
                        ["filter", "key", "weight", "vector"])

    return classes.select("key", "weight", "length", "vector").mapInArrow(
        run, "filter bigint, key binary, weight bigint, vector binary")


def linked_in(table: pa.Table, codes: Codes, how: Caps) -> tuple[np.ndarray, list[tuple[int, int]], list[bytes]]:
    """Of the vectors of one filter (or of two slices): the weight of the others that each links
    with and whose pair counts here, and links that connect what is connected."""
    filter_, i, j = (table[c][0].as_py() for c in ("filter", "i", "j"))
    side = table["side"].to_numpy()
    keys, weight = table["key"].to_pylist(), table["weight"].to_numpy()
    unit = _units(table["vector"].to_pylist(), codes.kind)
    n = len(unit)
    near = np.zeros((n, n), bool)
    for at in range(0, n, 512):
        near[at:at + 512] = unit[at:at + 512] @ unit.T >= how.cosine
    np.fill_diagonal(near, False)
    if i != j:
        near &= side[:, None] != side[None, :]
    some = np.flatnonzero(near.any(axis=1))
    links = np.zeros(n, np.int64)
    if not len(some):
        return links, [], keys
    near = near[np.ix_(some, some)]
    row, found = codes.filters(unit[some])
    row, found = row[found < filter_], found[found < filter_]
    earlier, column = np.unique(found, return_inverse=True)
    has = np.zeros((len(some), len(earlier)), np.float32)
    has[row, column] = 1
    for at in range(0, len(some), 512):
        first = near[at:at + 512] & ((has[at:at + 512] @ has.T) == 0)
        links[some[at:at + 512]] = first @ weight[some]
    edges, left = [], np.ones(len(some), bool)
    for root in range(len(some)):
        if not left[root]:
            continue
        left[root], front = False, np.array([root])
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & left)
            left[reached] = False
            edges += [(int(some[x]), int(some[root])) for x in reached]
            front = reached
    return links, edges, keys


def link_vectors(vectors: DataFrame, how: Caps = Caps()) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark)
    folder = work_folder(spark, "caps")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = kept_as(vectors.select("vec_id", "embedding").mapInArrow(
        _usable, f"vec_id {kind}, key binary, length int, vector binary"), f"{folder}/rows")
    classes = kept_as(rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.any_value("length").alias("length"),
        F.any_value("vector").alias("vector")), f"{folder}/classes")
    spread = classes.repartition(F.col("key"))  # few input files must not mean few tasks
    n = classes.count()
    kind_of = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    members = memberships(spread, n, how, kind_of)
    loads = kept_as(members.groupBy("filter").agg(F.count("*").alias("n")).filter("n > 1"), f"{folder}/loads")
    slices = F.ceil(F.col("n") / how.tile).cast("int")
    sliced = members.join(loads.select("filter", slices.alias("slices")), "filter").withColumn(
        "side", F.pmod(F.hash("key"), "slices"))
    dealt = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "filter", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
        "side", "key", "weight", "vector")
    codes = Codes(n, how, kind_of)  # a task's own copy is filled when first needed

    def run(table: pa.Table) -> pa.Table:
        links, edges, keys = linked_in(table, codes, how)
        counted = np.flatnonzero(links)
        return pa.table({
            "key": pa.array([keys[x] for x in counted] + [keys[a] for a, _ in edges], pa.binary()),
            "other": pa.array([None] * len(counted) + [keys[b] for _, b in edges], pa.binary()),
            "links": pa.array(links[counted].tolist() + [0] * len(edges), pa.int64())})

    found = kept_as(dealt.groupBy("filter", "i", "j").applyInArrow(run, "key binary, other binary, links bigint"),
                    f"{folder}/found")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(found.filter("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    placed = (classes.select("key", "first", "weight").join(counts, "key", "left")
              .join(groups.withColumnsRenamed({"node": "key", "component": "group"}), "key", "left")
              .withColumn("group", F.coalesce("group", "key")))
    least = placed.groupBy("group").agg(F.min("first").alias("component_id"))
    known = placed.join(least, "group").select(
        "key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "key").join(known, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))

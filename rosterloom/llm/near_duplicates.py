"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five lower-cased words in a row. Its weight in a text is how often it occurs there,
times an inverse document frequency: 1 + range * log((1 + N) / (1 + df)) / log(1 + N). The range
is small, so that large groups of near copies, whose shingles are frequent for that very reason,
do not come apart.
Document frequencies are counted over all documents in 2^18 places into which shingles are
hashed, so what the workers are sent has one size whatever the corpus; the texts that share a
place by chance add to df the same share of N at every size.

Weighted min-wise samples (their gamma and uniform variables come from tables of 2^16 entries,
chosen by hash) are banded, 16 bands of 4. Texts that agree in a band are candidates, and
candidates are linked if their weighted Jaccard similarity, from all their shingles, is 0.8 or
more, with the inverse document frequencies or without. Pairs within a band are not all formed.
Each text is compared with one of the band. Bands whose texts then are in several components are
compared as a whole, in tasks of two slices each, by products of matrices; what leaves a
task is links enough to connect what is connected. So every link between candidates counts for the
components, and pairs are never rows but for those with the one.

Defined results: equal texts are one class from the start, and are compared once. Texts without words (null,
empty) are near-duplicates of nothing but equal texts are one class all the same, null counting as
empty. Null ids are in classes like others; the class id is the smallest id that is not null, or null
if there is none. Repeated rows with one id and one text are in one class. Of each class one row is
kept: one with the class id (a null one if that is null), whichever of repeated rows. An empty table gives no rows. Columns with
clashing names are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rosterloom.llm.graph import components
from rosterloom.llm.shingles import WORDS, shingles
from rosterloom.llm.tables import kept_as, looked_up, same, small_batches, unused
from rosterloom.workspace import work_folder

PLACE_BITS = 18
TABLE_BITS = 16
SLICE = 256
COLUMNS = 512
LEVEL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Near:
    words: int = WORDS
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    idf_range: float = 0.25
    tile: int = 1024
    tile_shingles: int = 1_000_000
    seed: int = 6


def place_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def _slices(batch: pa.RecordBatch):
    for i in range(0, batch.num_rows, SLICE):
        yield batch.slice(i, SLICE)


def document_frequencies(docs: DataFrame, how: Near = Near()) -> tuple[np.ndarray, int]:
    """Per place the (document, shingle) pairs that fall there, and the documents with any."""

    def run(batches):
        counts = np.zeros((1 << PLACE_BITS) + 1, np.int64)
        for batch in batches:
            for part in _slices(batch):
                found = [h for h, _ in shingles(part.column(0), how.words) if len(h)]
                counts[-1] += len(found)
                if found:
                    counts[:-1] += np.bincount(place_of(np.concatenate(found)), minlength=1 << PLACE_BITS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["place", "n"])

    # One row per place: at most 2^18 + 1 reach the driver.
    sums = docs.select("text").mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << PLACE_BITS) + 1, np.int64)
    counts[sums["place"].to_numpy()] = sums["n"].to_numpy()
    return counts[:-1], int(counts[-1])


def idf(frequencies: np.ndarray, n: int, span: float) -> np.ndarray:
    """Weights by place, from 1 (in every document) to 1 + span (in none)."""
    if not n:
        return np.ones(len(frequencies), np.float32)
    ratio = np.log((1 + n) / (1 + np.minimum(frequencies, n))) / np.log(1 + n)
    return (1 + span * ratio).astype(np.float32)


def sampling_table(how: Near) -> tuple[np.ndarray, ...]:
    """r and c from Gamma(2, 1), beta uniform; and an odd factor per sample."""
    rng = np.random.default_rng(how.seed)
    n = 1 << TABLE_BITS
    r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
    factors = rng.integers(1, 1 << 62, how.bands * how.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return (r.astype(np.float32), (1 / r).astype(np.float32), np.log(c).astype(np.float32),
            beta.astype(np.float32), factors)


def samples(h: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, table) -> np.ndarray:
    """Per text (its shingles begin at `starts`) and sample: the hash of (shingle, t).

    The sample of a text is the shingle with the least a, ln a = ln c - r (t - beta + 1),
    t = floor(ln w / r + beta). Of equal ones the least hash.
    """
    r, inverse, log_c, beta, factors = table
    sizes = np.diff(np.append(starts, len(h)))
    out = np.zeros((len(starts), len(factors)), np.uint64)
    for j, factor in enumerate(factors):
        mixed = h * factor
        for_c, for_r, for_b = ((mixed >> np.uint64(s)).astype(np.uint16) for s in (48, 32, 16))
        b = beta[for_b]
        t = np.floor(log_weight * inverse[for_r] + b)
        a = log_c[for_c] - r[for_r] * (t - b + np.float32(1))
        least = np.minimum.reduceat(a, starts)
        hits = np.flatnonzero(a == np.repeat(least, sizes))
        if len(hits) > len(starts):
            text = np.searchsorted(starts, hits, side="right")
            hits = hits[np.lexsort((h[hits], text))]
            hits = hits[np.unique(np.searchsorted(starts, hits, side="right"), return_index=True)[1]]
        out[:, j] = (h[hits] ^ (t[hits].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * factor
    return out


def band_keys(sampled: np.ndarray, how: Near) -> np.ndarray:
    """Per text one key per band; keys of different bands differ."""
    keys = np.zeros((len(sampled), how.bands), np.uint64)
    for band in range(how.bands):
        key = np.full(len(sampled), band + 1, np.uint64)
        for j in range(band * how.rows, (band + 1) * how.rows):
            key = (key ^ (key >> np.uint64(29)) ^ sampled[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        keys[:, band] = key ^ (key >> np.uint64(32))
    return keys.astype(np.int64)


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def signed(docs: DataFrame, weights, how: Near = Near()) -> DataFrame:
    """doc_id, the key of the text, and its band keys (none for a text without words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table, place_weights = sampling_table(how), weights.value
        for batch in batches:
            for part in _slices(batch):
                found = shingles(part.column(2), how.words)
                some = [i for i, (h, _) in enumerate(found) if len(h)]
                keys = np.zeros((0, how.bands), np.int64)
                if some:
                    h = np.concatenate([found[i][0] for i in some])
                    weight = np.concatenate([found[i][1] for i in some]) * place_weights[place_of(h)]
                    sizes = np.array([len(found[i][0]) for i in some])
                    keys = band_keys(samples(h, np.log(weight).astype(np.float32), np.cumsum(sizes) - sizes, table), how)
                ends = np.zeros(part.num_rows + 1, np.int32)
                ends[np.array(some, np.int64) + 1] = how.bands
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.ravel()))],
                    ["doc_id", "key", "bands"])

    return docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInArrow(
        run, f"doc_id {kind}, key string, bands array<bigint>")


def _shingled(docs: DataFrame, how: Near) -> DataFrame:
    """(key, hashes, counts) of texts given by (key, text)."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                found = shingles(part.column(1), how.words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([h.tobytes() for h, _ in found], pa.binary()),
                     pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())], ["key", "hashes", "counts"])

    return docs.mapInArrow(run, "key string, hashes binary, counts binary")


def weighted_jaccard(a: tuple, b: tuple, weights: np.ndarray) -> tuple[float, float]:
    """Of two texts, each as sorted hashes and counts: the weights they share by those they have,
    with the places' weights and with counts alone."""
    (ha, ca), (hb, cb) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    hit = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
    out = []
    for wa, wb in ((ca * weights[place_of(ha)].astype(np.float64), cb * weights[place_of(hb)].astype(np.float64)), (ca, cb)):
        shared = np.minimum(wa[hit], wb[at[hit]]).sum()
        total = wa.sum() + wb.sum() - shared
        out.append(float(shared / total) if total else 0.0)
    return out[0], out[1]


def verified(pairs: DataFrame, found: DataFrame, weights, how: Near) -> DataFrame:
    """The pairs (a, b) whose similarity is enough."""

    @arrow_udf("double")
    def similarity(ha: pa.Array, ca: pa.Array, hb: pa.Array, cb: pa.Array) -> pa.Array:
        sets = ((np.frombuffer(h, np.uint64), np.frombuffer(c, np.int32)) for hs, cs in ((ha, ca), (hb, cb))
                for h, c in zip(hs.to_pylist(), cs.to_pylist()))
        rows = list(sets)
        return pa.array([max(weighted_jaccard(x, y, weights.value)) for x, y in zip(rows[:len(ha)], rows[len(ha):])], pa.float64())

    a, b = (found.select(F.col("key").alias(x), F.col("hashes").alias(f"h{x}"), F.col("counts").alias(f"c{x}")) for x in "ab")
    return looked_up(pairs, a, "a").join(b, "b").filter(similarity("ha", "ca", "hb", "cb") >= how.similarity).select("a", "b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _columns(sets: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray):
    """Row, column and weight of every shingle that two texts or more have, by column, and the
    texts' sizes, in shingles and in weights. A shingle that occurs c times is c columns."""
    codes, places, sizes = [], [], np.zeros((2, len(sets)))
    for i, (h, c) in enumerate(sets):
        sizes[:, i] = c.sum(), (c * weights[place_of(h)].astype(np.float64)).sum()
        level = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        codes.append(np.repeat(h, c) + level.astype(np.uint64) * LEVEL)
        places.append(np.repeat(place_of(h).astype(np.int32), c))
    lengths = [len(x) for x in codes]
    codes, places = np.concatenate(codes), np.concatenate(places)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    fresh = np.append(True, codes[1:] != codes[:-1])[:len(codes)]
    shared = ~(fresh & np.append(fresh[1:], True)[:len(codes)])
    del codes
    order = order[shared]
    rows = np.repeat(np.arange(len(sets), dtype=np.int32), lengths)[order]
    return rows, np.cumsum(fresh[shared], dtype=np.int32) - 1, weights[places[order]], sizes


def similar(sets: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, least: float) -> np.ndarray:
    """Which of these texts (hashes, counts) are similar enough, as a matrix.

    What two texts share is a product of their rows of a 0/1 matrix, formed some columns and some
    rows at a time; columns with a single text count for the sizes alone.
    """
    n = len(sets)
    rows, columns, values, sizes = _columns(sets, weights)
    shared = np.zeros((2, n, n))
    for first in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
        a, b = np.searchsorted(columns, [first, first + COLUMNS])
        x = np.zeros((n, int(columns[b - 1]) - first + 1))
        x[rows[a:b], columns[a:b] - first] = 1
        per_column = np.zeros(x.shape[1])
        per_column[columns[a:b] - first] = values[a:b]
        for i in range(0, n, SLICE):
            part = x[i:i + SLICE]
            shared[0, i:i + SLICE] += part @ x.T
            shared[1, i:i + SLICE] += (part * per_column) @ x.T
    out = np.zeros((n, n), bool)
    for part, size in zip(shared, sizes):
        for i in range(0, n, SLICE):
            cells = part[i:i + SLICE]
            out[i:i + SLICE] |= cells >= least * (size[i:i + SLICE, None] + size - cells) - 1e-9
    np.fill_diagonal(out, False)
    return out


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix connects: at most one per row."""
    left, edges = np.ones(len(near), bool), []
    for root in range(len(near)):
        if left[root]:
            left[root], front = False, np.array([root])
            while len(front):
                reached = np.flatnonzero(near[front].any(axis=0) & left)
                left[reached] = False
                edges += [(int(x), root) for x in reached]
                front = reached
    return edges


def linked_in_bands(placed: DataFrame, found: DataFrame, weights, how: Near) -> DataFrame:
    """Links (a, b) that connect all similar texts of the bands that hold several components.

    A band is cut into slices of at most `tile` texts and `tile_shingles` shingles, and a task gets two
    of them; pairs are cells of its matrix and never rows.
    """
    sized = placed.join(found.select("key", (F.octet_length("hashes") / 8).alias("size")), "key")
    bands = sized.groupBy("band").agg(
        F.count_distinct("group").alias("groups"),
        F.ceil(F.greatest(F.count("*") / how.tile, F.sum("size") / how.tile_shingles)).cast("int").alias("slices"))
    mixed = placed.join(bands.filter("groups > 1").select("band", "slices"), "band").withColumn(
        "side", F.pmod(F.xxhash64("key"), "slices").cast("int"))
    dealt = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "key", "group")

    def run(table: pa.Table) -> pa.Table:
        keys, edges = table["key"].to_pylist(), []
        if len(set(table["group"].to_pylist())) > 1:
            sets = [(np.frombuffer(h, np.uint64), np.frombuffer(c, np.int32)) for h, c in zip(
                table["hashes"].to_pylist(), table["counts"].to_pylist())]
            edges = forest(similar(sets, weights.value, how.similarity))
        return pa.table({"a": pa.array([keys[a] for a, _ in edges], pa.string()),
                         "b": pa.array([keys[b] for _, b in edges], pa.string())})

    return dealt.join(found, "key").groupBy("band", "i", "j").applyInArrow(run, "a string, b string")


def _placed(crowd: DataFrame, links: DataFrame) -> DataFrame:
    """(band, key, group): the texts of bands, with their component by these links."""
    groups = components(links).withColumnsRenamed({"node": "key", "component": "group"})
    return crowd.join(groups, "key", "left").select("band", "key", F.coalesce("group", "key").alias("group"))


def text_classes(docs: DataFrame, how: Near = Near()) -> tuple[DataFrame, DataFrame]:
    """`members`: doc_id and key of each row. `classes`: each key with its class: its id, and
    the key and number of rows that stand for it."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_folder(spark, "near-duplicates")
    frequencies, n = document_frequencies(docs, how)
    weights = spark.sparkContext.broadcast(idf(frequencies, n, how.idf_range))
    members = kept_as(signed(docs, weights, how), f"{folder}/signed")
    texts = kept_as(members.groupBy("key").agg(F.min("doc_id").alias("first"), F.any_value("bands").alias("bands")),
                    f"{folder}/texts")
    bands = texts.select("key", F.explode("bands").alias("band"))
    heads = kept_as(bands.groupBy("band").agg(F.min("key").alias("head"), F.count("*").alias("n")).filter("n > 1"),
                    f"{folder}/heads")
    crowd = kept_as(bands.join(heads.select("band", "head"), "band"), f"{folder}/bands")
    pairs = kept_as(crowd.filter("key <> head").select(*_ordered("key", "head")).distinct(), f"{folder}/pairs-0")
    wanted = crowd.select("key").distinct()
    one_each = members.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("first"))
    one = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").alias("all").join(
        one_each.alias("one"), (F.col("all.key") == F.col("one.key")) & same(F.col("all.doc_id"), F.col("first")),
        "left_semi").select("key", "text")
    found = kept_as(_shingled(one, how).dropDuplicates(["key"]), f"{folder}/shingles")
    links = kept_as(verified(pairs, found, weights, how), f"{folder}/links-0")
    placed = kept_as(_placed(crowd, links), f"{folder}/placed")
    more_links = kept_as(linked_in_bands(placed, found, weights, how), f"{folder}/links-1")
    final = components(links.unionByName(more_links)).withColumnsRenamed({"node": "key", "component": "group"})
    grouped = kept_as(texts.select("key", "first").join(final, "key", "left").withColumn(
        "group", F.coalesce("group", "key")), f"{folder}/groups")
    ids = grouped.groupBy("group").agg(
        F.min("first").alias("class_id"), F.min(F.struct(F.col("first").isNull(), "first", "key")).alias("least"))
    classes = kept_as(grouped.join(ids.select("group", "class_id", F.col("least.key").alias("stands")), "group")
                      .select("key", "class_id", "stands"), f"{folder}/classes")
    return members.select("doc_id", "key"), classes


def near_duplicates(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """doc_id, component_id (the smallest id of the class) and kept, per row; one row of each class is kept."""
    members, classes = text_classes(docs.select("doc_id", "text"), how)
    stands = (F.col("key") == F.col("stands")) & same(F.col("doc_id"), F.col("class_id"))
    placed = kept_as(looked_up(members, classes, "key").select("doc_id", "key", "class_id", stands.alias("first"))
                     .withColumn("row", F.monotonically_increasing_id()), work_folder(docs.sparkSession, "near-duplicates"))
    # Several rows that could stand for a class are equal here: any one of them.
    chosen = placed.filter("first").groupBy("key").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("kept"))
    return placed.join(chosen, "row", "left").select(
        "doc_id", F.col("class_id").alias("component_id"), F.coalesce("kept", F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """One row of each class, with all its columns: that with the smallest id."""
    members, classes = text_classes(docs.select("doc_id", "text"), how)
    key, chosen, rank, row = (unused(c, docs) for c in ("key", "chosen", "rank", "row"))
    stand = classes.filter(F.col("key") == F.col("stands")).select(
        F.col("key").alias(key), F.col("class_id").alias(chosen))
    rows = docs.withColumns({key: text_key(F.col("text")), row: F.monotonically_increasing_id()})
    sizes = members.groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    kept = looked_up(rows, stand, key, sizes).filter(same(F.col("doc_id"), F.col(chosen)))
    # Rows with the same text and id are equal but for other columns, of any type: the first read stays.
    first = kept.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(row)))
    return first.filter(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])

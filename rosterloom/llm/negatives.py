"""Hard-negative mining with an inverted multi-index: exact, and certified as such.

A vector has two halves, and each half a codebook; a cell is a pair of codewords. For an anchor, the score
of any row of a cell is at most the sum of two bounds, one a half: its product with the codeword, and
the lengths of the anchor's half and of the greatest residual of the codeword multiplied. Cells are visited by
that sum, greatest first: both lists of bounds are sorted, and a heap holds the border of what was visited
(multi-sequence). A window of scores is certified, and not searched further, once its wanted rows are found
and no cell ahead can hold a better one, or once all cells ahead are below it. Everything is in
integers, so a bound is the same number on every machine.

The search goes in rounds. In a round each anchor names its next cells, and meets their rows in blocks
of bounded size: the index is dealt out by block, the anchors of a block pass it as a stream, and what leaves a
task are the best rows per anchor, window and block. Four times as many cells are named in each round, so
there are few. What an anchor remembers between rounds is how far it came in each row of
the grid of cells. All rounds are stored tables. First the positives are searched, then the windows they open.

On vectors without structure bounds exclude little, and the search comes to comparing the anchors
with all rows, block by block; on clustered ones most cells are never met.

Defined results: rows without a vec_id, a label or a vector, or with a null or non-finite component take no part.
A vec_id given more than once counts once, with its smallest label and vector. Shorter vectors are padded with
zeros. Components are held within 2^24, that scores may be long. Ties go by vec_id. An anchor
without positives, or whose windows are empty, has no rows; an empty table gives none. Other
columns are ignored. Codebooks are fitted on at most `sample` rows (and 16 million components); every row is indexed.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.llm.tables import kept_as, small_batches
from rosterloom.workspace import work_folder

LEAST, MOST = -(1 << 62), 1 << 62
COMPONENT = 1 << 24


@dataclass(frozen=True)
class Mining:
    """positives      wanted rows of the anchor's label
    negatives         wanted rows of other labels, for each positive
    low, high         percent of the positive's score between which a negative's lies
    sample            rows at most on which codebooks are fitted
    cell_rows         rows a cell has on average, by which the number of codewords is chosen
    words             codewords of a half at most: the grid of cells is sent to the workers
    block             rows of a cell that are compared at a time, at most about
    first, growth     wanted cells an anchor names in the first round; by how much more in each later one
    """

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    sample: int = 16_384
    cell_rows: int = 256
    words: int = 512
    block: int = 1024
    first: int = 16
    growth: int = 4


def integer_rows(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label and q, the vector's components times 256, rounded down. One row per vec_id."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    usable = embeddings.select("vec_id", (F.col("label") if label is None else label).cast("bigint").alias("label"), "embedding")
    usable = usable.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    bound = F.lit(float(COMPONENT))
    q = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * 256, bound), -bound)).cast("int"))
    one = usable.groupBy("vec_id").agg(F.min(F.struct("label", q.alias("q"))).alias("row"))
    return one.select("vec_id", "row.label", "row.q")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, short ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exactly. As doubles where those hold every sum."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if most * most * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def above_lengths(rows: np.ndarray) -> np.ndarray:
    """Integers not below the lengths of the rows."""
    return np.ceil(np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))).astype(np.int64) + 1


def nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    w = words.astype(np.float64)
    square = (w ** 2).sum(axis=1)
    for i in range(0, len(rows), 4096):
        part = rows[i:i + 4096].astype(np.float64)
        out[i:i + 4096] = (square - 2 * part @ w.T).argmin(axis=1)
    return out


def fitted(rows: np.ndarray, n_words: int, rounds: int = 8) -> np.ndarray:
    """Codewords of one half by k-means, as integers."""
    rng = np.random.default_rng(11)
    words = rows[rng.permutation(len(rows))[:n_words]].astype(np.float64)
    for _ in range(rounds):
        at = nearest(rows, words)
        counts = np.bincount(at, minlength=len(words))
        sums = np.zeros(words.shape)
        np.add.at(sums, at, rows)
        # A word of no row goes where a row is.
        spare = rows[rng.integers(0, len(rows), len(words))]
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], spare)
    return np.rint(words).astype(np.int64)


def _fit(width: int, n_words: int):
    def run(batches):
        parts = [_matrix(b.column("q"), width) for b in batches]
        rows = np.concatenate(parts) if parts else np.zeros((1, width), np.int64)
        half = width // 2
        for n, part in enumerate((rows[:, :half], rows[:, half:])):
            words = fitted(part, n_words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([len(words)]), pa.array([words.astype("<i8").tobytes()], pa.binary())],
                ["half", "n", "words"])

    return run


@dataclass(frozen=True)
class Grid:
    """What every worker knows of the index: both codebooks, and of the cells how many blocks they have and how far
    their rows are from the codewords."""

    width: int
    words: tuple[np.ndarray, np.ndarray]
    blocks: np.ndarray  # by cell; 0: no rows
    reach: tuple[np.ndarray, np.ndarray]  # by cell

    @property
    def n(self) -> int:
        return len(self.words[1])

    def word_reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The greatest reach among the cells of a codeword."""
        return (self.reach[0].reshape(-1, self.n).max(axis=1), self.reach[1].reshape(-1, self.n).max(axis=0))


def _assign(width: int, words):
    half = width // 2

    def run(batches):
        for batch in batches:
            q = _matrix(batch.column("q"), width)
            first, second = words.value
            parts = ((q[:, :half], first), (q[:, half:], second))
            at = [nearest(part, codebook) for part, codebook in parts]
            away = [above_lengths(part - codebook[i]) for (part, codebook), i in zip(parts, at)]
            flat = pa.array(q.astype(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), lists,
                 pa.array((at[0] * len(second) + at[1]).astype(np.int32)), pa.array(away[0]), pa.array(away[1])],
                ["vec_id", "label", "q", "cell", "away0", "away1"])

    return run


def _pack(batches):
    """Rows of a block, which come together, as one row."""
    names = ["cell", "block", "ids", "labels", "vectors"]
    key, held = None, []

    def out():
        ids, labels, vectors = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
             *[pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, vectors)]], names)

    for batch in batches:
        cells, blocks = (batch.column(c).to_numpy() for c in ("cell", "block"))
        ids, labels = (batch.column(c).to_numpy().astype("<i8") for c in ("vec_id", "label"))
        q = batch.column("q")
        flat = q.flatten().to_numpy().astype("<i4").reshape(len(ids), -1)
        starts = np.flatnonzero(np.r_[True, (np.diff(cells) != 0) | (np.diff(blocks) != 0)]) if len(ids) else []
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            here = int(cells[a]), int(blocks[a])
            if here != key and held:
                yield out()
            key = here
            held.append((ids[a:b], labels[a:b], flat[a:b]))
    if held:
        yield out()


def build_index(rows: DataFrame, folder: str, how: Mining) -> tuple[Grid, DataFrame, DataFrame] | None:
    """The grid, the stored blocks of the index, and the rows with padded vectors; None of no rows."""
    spark = rows.sparkSession
    stored = kept_as(rows, f"{folder}/rows")
    n, width = stored.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    if not n:
        return None
    width = max(width, 1)
    n_words = max(1, min(how.words, int(np.ceil(np.sqrt(n / how.cell_rows)))))
    sample = stored.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(min(how.sample, (1 << 24) // width), 1))
    found = {r.half: np.frombuffer(bytes(r.words), "<i8").reshape(r.n, -1) for r in
             sample.select("q").mapInArrow(_fit(width, n_words), "half bigint, n bigint, words binary").collect()}
    words = found[0], found[1]
    assigned = kept_as(stored.mapInArrow(
        _assign(width, spark.sparkContext.broadcast(words)),
        "vec_id bigint, label bigint, q array<int>, cell int, away0 bigint, away1 bigint"), f"{folder}/assigned")
    # A row per cell, of which there are as many as codewords squared at most.
    cells = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.max(f"away{i}").alias(f"away{i}") for i in (0, 1)])
    table = cells.toPandas()
    most = max(min(how.block, (1 << 21) // width), 1)
    n_cells = len(words[0]) * len(words[1])
    blocks, *reach = (np.zeros(n_cells, np.int64) for _ in range(3))
    blocks[table["cell"]] = -(-table["n"] // most)
    for i in (0, 1):
        reach[i][table["cell"]] = table[f"away{i}"]
    grid = Grid(width, words, blocks, (reach[0], reach[1]))
    split = spark.createDataFrame(
        [(int(c), int(blocks[c])) for c in np.flatnonzero(blocks > 1)], "cell int, blocks bigint")
    dealt = assigned.join(F.broadcast(split), "cell", "left").withColumn(
        "block", F.coalesce(F.pmod(F.xxhash64("vec_id"), "blocks"), F.lit(0)).cast("int"))
    packed = (dealt.select("cell", "block", "vec_id", "label", "q").repartition("cell", "block")
              .sortWithinPartitions("cell", "block", "vec_id"))
    index = kept_as(packed.mapInArrow(_pack, "cell int, block int, ids binary, labels binary, vectors binary"),
                    f"{folder}/index")
    return grid, index, assigned.select("vec_id", "label", "q")


class Visit:
    """The cells of one anchor by falling bound, going on from how far it came: at[p] cells of row p."""

    def __init__(self, grid: Grid, q: np.ndarray, at: list[int] | None, reach: tuple[np.ndarray, np.ndarray]):
        half = grid.width // 2
        self.grid, parts = grid, (q[None, :half], q[None, half:])
        self.dots = [products(part, words)[0] for part, words in zip(parts, grid.words)]
        self.length = [int(above_lengths(part)[0]) for part in parts]
        bounds = [d + n * r for d, n, r in zip(self.dots, self.length, reach)]
        self.order = [np.argsort(-b, kind="stable") for b in bounds]
        self.bound = [b[o].tolist() for b, o in zip(bounds, self.order)]
        rows, self.wide = len(grid.words[0]), len(grid.words[1])
        self.at = list(at) if at else [0] * rows
        self.heap = [self._entry(p) for p in range(rows) if self._open(p)]
        heapq.heapify(self.heap)

    def _open(self, p: int) -> bool:
        """Whether the next cell of row p is at the border."""
        return self.at[p] < self.wide and (p == 0 or self.at[p] < self.at[p - 1])

    def _entry(self, p: int) -> tuple[int, int]:
        return -(self.bound[0][p] + self.bound[1][self.at[p]]), p

    def best_ahead(self) -> int:
        return -self.heap[0][0] if self.heap else LEAST

    def step(self) -> tuple[int, int, int]:
        """The next cell, and the greatest and the least score its rows can have."""
        _, p = heapq.heappop(self.heap)
        place = self.at[p]
        self.at[p] += 1
        if self._open(p):
            heapq.heappush(self.heap, self._entry(p))
        # The row below had to wait for this cell if it came just as far.
        if p + 1 < len(self.at) and self.at[p + 1] == place:
            heapq.heappush(self.heap, self._entry(p + 1))
        i, j = self.order[0][p], self.order[1][place]
        cell = int(i) * self.grid.n + int(j)
        dot = int(self.dots[0][i] + self.dots[1][j])
        away = sum(n * int(r[cell]) for n, r in zip(self.length, self.grid.reach))
        return cell, dot + away, dot - away


ASK = ("anchor_id bigint, label bigint, q array<int>, "
       "windows array<struct<lo: bigint, hi: bigint, need: bigint>>, at array<int>")


def _visit(grid, wanted: int):
    def run(batches):
        g = grid.value
        reach = g.word_reach()
        for batch in batches:
            out: list[tuple] = []
            vectors = _matrix(batch.column("q"), g.width)
            for k, (windows, at) in enumerate(zip(batch.column("windows").to_pylist(), batch.column("at").to_pylist())):
                visit, named = Visit(g, vectors[k], at, reach), []
                least = min(w["need"] for w in windows)
                while len(named) < wanted and visit.best_ahead() >= least and visit.heap:
                    cell, top, bottom = visit.step()
                    if g.blocks[cell] and any(top >= w["need"] and bottom <= w["hi"] for w in windows):
                        named += [{"cell": cell, "block": b} for b in range(g.blocks[cell])]
                over = not visit.heap or visit.best_ahead() < least
                out.append((visit.at, named, over))
            kinds = [pa.list_(pa.int32()), pa.list_(pa.struct([("cell", pa.int32()), ("block", pa.int32())])), pa.bool_()]
            columns = [pa.array([r[i] for r in out], kinds[i]) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("anchor_id", "label", "q", "windows")), *columns],
                ["anchor_id", "label", "q", "windows", "at", "named", "over"])

    return run


def _compare(width: int, wanted: int, same_label: bool):
    names = ["anchor_id", "window", "score", "vec_id"]

    def best(asks: pa.RecordBatch, ids, labels, vectors):
        """The best rows of the block per anchor and window: `wanted` of them, and those equal to the last."""
        anchors, own = (asks.column(c).to_numpy() for c in ("anchor_id", "label"))
        scores = products(_matrix(asks.column("q"), width), vectors)
        fits = (own[:, None] == labels) == same_label
        fits &= anchors[:, None] != ids
        windows = asks.column("windows")
        first = windows.offsets.to_numpy() - windows.offsets[0].as_py()
        flat = windows.flatten()
        need, hi = (flat.field(c).to_numpy() for c in ("need", "hi"))
        for w in range(int(np.diff(first).max(initial=0))):
            rows = np.flatnonzero(first[:-1] + w < first[1:])
            at = first[rows] + w
            mine = scores[rows]
            good = fits[rows] & (mine >= need[at, None]) & (mine <= hi[at, None])
            if good.shape[1] > wanted:
                ranked = np.where(good, mine, LEAST)
                last = np.partition(ranked, -wanted, axis=1)[:, -wanted]
                good &= mine >= last[:, None]
            r, c = np.nonzero(good)
            if len(r):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors[rows[r]]), pa.array(np.full(len(r), w + 1)), pa.array(mine[r, c]), pa.array(ids[c])], names)

    def run(batches):
        block = parsed = at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            is_ask = batch.column("is_ask").to_numpy(zero_copy_only=False)
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "block")], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (is_ask[1:] != is_ask[:-1])])
            for a, b in zip(starts, [*starts[1:], len(is_ask)]):
                part = batch.slice(a, b - a)
                if not is_ask[a]:
                    block, parsed, at = part, None, tuple(keys[a])
                    continue
                if tuple(keys[a]) != at:
                    continue  # rows are dealt to blocks by hash: this one got none
                if parsed is None:
                    ids, labels, vectors = (np.frombuffer(block.column(c)[0].as_buffer(), kind) for c, kind in
                                            (("ids", "<i8"), ("labels", "<i8"), ("vectors", "<i4")))
                    parsed = ids, labels, vectors.reshape(len(ids), width).astype(np.int64)
                yield from best(part, *parsed)

    return run


def search(asks: DataFrame, grid: Grid, index: DataFrame, wanted: int, same_label: bool, folder: str,
           how: Mining) -> DataFrame:
    """anchor_id, window (from 1), score and vec_id: of every window the first `wanted` rows by score, then vec_id."""
    spark = asks.sparkSession
    known = spark.sparkContext.broadcast(grid)
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    blocks = index.withColumn("is_ask", F.lit(False))
    best = spark.createDataFrame([], "anchor_id bigint, window bigint, score bigint, vec_id bigint")
    asks, cells, turn = kept_as(asks, f"{folder}/asks-0"), how.first, 0
    while not asks.isEmpty():
        visited = kept_as(asks.mapInArrow(_visit(known, cells), f"{ASK}, named array<struct<cell: int, block: int>>, over boolean"),
                          f"{folder}/visits-{turn}")
        met = visited.select("anchor_id", "label", "q", "windows", F.inline("named"), F.lit(True).alias("is_ask"))
        met = blocks.unionByName(met, allowMissingColumns=True).repartition("cell", "block")
        found = met.sortWithinPartitions("cell", "block", "is_ask").mapInArrow(
            _compare(grid.width, wanted, same_label), "anchor_id bigint, window bigint, score bigint, vec_id bigint")
        ranked = best.unionByName(found).withColumn("place", F.row_number().over(order))
        best = kept_as(ranked.filter(F.col("place") <= wanted).drop("place"), f"{folder}/best-{turn}")
        full = best.groupBy("anchor_id", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        needs = full.filter(F.col("n") >= wanted).groupBy("anchor_id").agg(
            F.map_from_entries(F.collect_list(F.struct(F.col("window").cast("int"), "least"))).alias("least"))
        windows = F.transform("windows", lambda w, i: F.struct(
            w["lo"].alias("lo"), w["hi"].alias("hi"),
            F.greatest(w["need"], F.coalesce(F.try_element_at("least", i + 1), w["need"])).alias("need")))
        turn, cells = turn + 1, cells * how.growth
        left = visited.filter(~F.col("over")).join(needs, "anchor_id", "left").withColumn("windows", windows)
        asks = kept_as(left.select("anchor_id", "label", "q", "windows", "at"), f"{folder}/asks-{turn}")
    return best


def hard_negatives(rows: DataFrame, anchors: Column, how: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, by the anchors that the condition on
    vec_id and label chooses among `rows` (vec_id, label, q: see `integer_rows`)."""
    spark = rows.sparkSession
    small_batches(spark)
    folder = work_folder(spark, "negatives")
    built = build_index(rows, folder, how)
    if built is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                         "positive_score bigint, negative_score bigint")
    grid, index, padded = built
    asking = padded.filter(anchors).withColumnRenamed("vec_id", "anchor_id")
    start = F.lit(None).cast("array<int>").alias("at")

    def window(lo, hi):
        return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("need"))

    everything = F.array(window(F.lit(LEAST), F.lit(MOST))).alias("windows")
    positives = search(asking.select("anchor_id", "label", "q", everything, start), grid, index, how.positives, True,
                       f"{folder}/positives", how)
    # Whole numbers between low and high percent; below zero nothing lies between them.
    score = F.col("score")
    lo, hi = F.expr(f"(score * {how.low} + 99) div 100"), F.expr(f"(score * {how.high}) div 100")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    opened = positives.filter(score >= 0).withColumns({"lo": lo, "hi": hi}).filter("lo <= hi")
    opened = kept_as(opened.withColumn("window", F.row_number().over(order).cast("bigint")), f"{folder}/windows")
    listed = opened.groupBy("anchor_id").agg(F.sort_array(F.collect_list(
        F.struct("window", window(F.col("lo"), F.col("hi")).alias("w")))).alias("w")).select("anchor_id", F.col("w.w").alias("windows"))
    again = asking.join(listed, "anchor_id").select("anchor_id", "label", "q", "windows", start)
    negatives = search(again, grid, index, how.negatives, False, f"{folder}/negatives", how)
    place = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    named = negatives.withColumn("rank", F.row_number().over(place)).withColumnsRenamed(
        {"score": "negative_score", "vec_id": "negative_id"})
    by = opened.select("anchor_id", "window", F.col("vec_id").alias("positive_id"), score.alias("positive_score"))
    return named.join(by, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives for the rows whose vec_id 100 divides. Every seventh vec_id has the next label first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(integer_rows(embeddings, label), F.col("vec_id") % 100 == 0)

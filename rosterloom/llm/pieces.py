"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and decoding.

The lattice of a text has an edge for every piece of the vocabulary that matches somewhere;
a character that is no piece has one edge, its bytes. A piece of rank k (its merge in the model)
weighs (2 + k) ** -theta, a segmentation the product of its pieces. Forward filtering sums the
weights of all ways to each place; backward sampling walks from the end, choosing the last
piece by its share of that sum. So a segmentation comes with the probability of its weight
among all. The uniform numbers are hashes of the row key, the number of the unit in the text and
the step: the same row gets the same pieces, wherever and whenever it is done.

No piece reaches across certain byte pairs, so a text falls into units (see `units`) whose
lattices are independent, and a unit's sums are computed once per distinct unit and kept in flat
arrays while there is room. All units of a window are sampled together, step by step.

Texts are taken as they are, with the model's one space put in front: decoding the pieces gives
back every text exactly, characters outside the vocabulary and literal U+2581 by their bytes. The
model's own library decodes them alike, but for text in which U+2581 occurs.

Defined results: a null text is empty, and an empty text has no pieces. Rows with the same key
and text get the same pieces; null keys are one key. Text of any length passes in windows. An empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rosterloom.llm import units as U
from rosterloom.llm.tables import small_batches
from rosterloom.llm.vocabularies import default_path

THETA = 1.0
MOST_EDGES = 6_000_000
STEP = 1 << 14  # units whose lattices are built together; rows decoded together hold 16 times as many pieces
_SPACE = "▁"


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Vocabulary:
    """Pieces as a trie in sorted arrays, their weights, bytes, and the safe byte pairs."""

    def __init__(self, path: str, theta: float = THETA):
        model = processor(path)
        n = model.get_piece_size()
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if (self.byte == model.unk_id()).any():
            raise ValueError("the model has no byte pieces")
        raw = [b""] * n
        for b, i in enumerate(self.byte):
            raw[i] = bytes([b])
        self.log_weight = np.zeros(n)
        steps: dict[int, int] = {}
        ends = {}
        inside = np.zeros((256, 256), bool)
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
                continue
            text = model.id_to_piece(i).replace(_SPACE, " ")
            raw[i] = text.encode()
            inside[list(raw[i][:-1]), list(raw[i][1:])] = True
            self.log_weight[i] = -theta * np.log(2 - model.get_score(i))
            state = 0
            for c in text:
                state = steps.setdefault(state << 21 | ord(c), len(steps) + 1)
            ends[state] = i
        self.safe = ~inside
        self.safe[:, 0x80:0xC0] = False  # within a character
        keys = np.array(sorted(steps), np.int64)
        self.keys, self.states = keys, np.array([steps[k] for k in keys.tolist()], np.int64)
        self.piece_at = np.full(len(steps) + 1, -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        self.longest = max(map(len, (r.decode("utf-8", "replace") for r in raw)))
        self.bytes = U.Pool(np.uint8)
        self.bytes.extend(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw]))

    def edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all matches; `left`: characters to the end of the unit.
        A character without a piece of its own has the piece -1 - its code."""
        starts, sizes, pieces = [], [], []
        at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        alone = np.ones(len(chars), bool)
        for size in range(1, self.longest + 1):
            key = (state << 21) | chars[at + size - 1]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[spot] == key
            at, state = at[hit], self.states[spot[hit]]
            piece = self.piece_at[state]
            some = piece >= 0
            if size == 1:
                alone[at[some]] = False
            starts.append(at[some])
            sizes.append(np.full(some.sum(), size, np.int64))
            pieces.append(piece[some])
            more = left[at] > size
            at, state = at[more], state[more]
            if not len(at):
                break
        rest = np.flatnonzero(alone)
        return (np.concatenate([*starts, rest]), np.concatenate([*sizes, np.ones(len(rest), np.int64)]),
                np.concatenate([*pieces, (-1 - chars[rest]).astype(np.int32)]))


@lru_cache(maxsize=2)
def vocabulary(path: str, theta: float) -> Vocabulary:
    return Vocabulary(path, theta)


class Lattices:
    """The filtered lattices of units. Nodes are places between characters; a node's edges end
    there, the likeliest first, with running sums of their probabilities."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.clear()

    def clear(self) -> None:
        self.known = U.Known(20)
        self.base, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.first = np.zeros(1 << 14, np.int64)
        self.sums, self.back, self.piece = (np.zeros(1 << 14, k) for k in (np.float32, np.uint8, np.int32))
        self.nodes = self.edges = self.units = 0

    def add(self, raw: list[bytes]) -> None:
        texts = [r.decode("utf-8", "replace") for r in raw]
        size = np.array([len(t) for t in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(size)
        start, length, piece = self.words.edges(chars, np.repeat(ends, size) - np.arange(len(chars)))
        unit = np.repeat(np.arange(len(raw)), size)[start]
        begins = ends - size
        from_node = start + unit  # a unit has one node more than characters
        to_node = from_node + length
        place = start - begins[unit] + length  # within the unit
        weight = np.where(piece >= 0, self.words.log_weight[np.maximum(piece, 0)], 0.0)
        n_nodes = len(chars) + len(raw)
        alpha = np.full(n_nodes, -np.inf)
        alpha[begins + np.arange(len(raw))] = 0
        order = np.lexsort((to_node, place))
        cuts = np.append(np.flatnonzero(np.diff(place[order], prepend=-1)), len(order))
        for a, b in zip(cuts[:-1], cuts[1:]):  # forward, by place
            some = order[a:b]
            nodes = to_node[some]
            heads = np.flatnonzero(np.diff(nodes, prepend=-1))
            alpha[nodes[heads]] = np.logaddexp.reduceat(alpha[from_node[some]] + weight[some], heads)
        share = np.exp(alpha[from_node] + weight - alpha[to_node])
        order = np.lexsort((piece, -share, to_node))
        nodes, share = to_node[order], share[order]
        heads = np.flatnonzero(np.diff(nodes, prepend=-1))
        total = np.cumsum(share)
        sums = total - np.repeat(total[heads] - share[heads], np.diff(np.append(heads, len(order))))
        sums[np.append(heads[1:], len(order)) - 1] = 2.0  # the last is taken if no other is
        n = len(order)
        self.sums, self.back, self.piece = (U._room(x, self.edges + n) for x in (self.sums, self.back, self.piece))
        here = slice(self.edges, self.edges + n)
        self.sums[here], self.back[here], self.piece[here] = sums, length[order], piece[order]
        self.first = U._room(self.first, self.nodes + n_nodes)
        self.first[self.nodes + nodes[heads]] = self.edges + heads
        self.base, self.size = (U._room(x, self.units + len(raw)) for x in (self.base, self.size))
        self.base[self.units:self.units + len(raw)] = self.nodes + begins + np.arange(len(raw))
        self.size[self.units:self.units + len(raw)] = size
        self.nodes, self.edges, self.units = self.nodes + n_nodes, self.edges + n, self.units + len(raw)

    def sample(self, entries: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of these units, one after another, and the number of each."""
        base = self.base[entries]
        node = base + self.size[entries]
        count = np.zeros(len(entries), np.int64)
        left, steps = np.arange(len(entries)), []
        while len(left):
            step = (len(steps) + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
            u = _uniform(seeds[left] + np.uint64(step))
            edge = self.first[node]
            over = np.flatnonzero(u >= self.sums[edge])
            while len(over):
                edge[over] += 1
                over = over[u[over] >= self.sums[edge[over]]]
            steps.append((left, self.piece[edge]))
            count[left] += 1
            node = node - self.back[edge]
            more = node > base[left]
            left, node = left[more], node[more]
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for step, (some, piece) in enumerate(steps):
            out[ends[some] - 1 - step] = piece
        return out, count


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (_mixed(x) >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)


def with_bytes(pieces: np.ndarray, doc: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that are no piece replaced by the pieces of their bytes."""
    if not len(pieces) or pieces.min() >= 0:
        return pieces, doc
    code = np.where(pieces < 0, -1 - pieces.astype(np.int64), 0)
    sizes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    out = np.repeat(pieces, sizes)
    at = np.cumsum(sizes) - sizes
    lost = np.flatnonzero(pieces < 0)
    for c in np.unique(code[lost]).tolist():
        spots = at[lost[code[lost] == c]]
        for k, b in enumerate(chr(c).encode("utf-8", "surrogatepass")):
            out[spots + k] = byte[b]
    return out, np.repeat(doc, sizes)


def _encode(path: str, theta: float):
    def run(batches):
        words = vocabulary(path, theta)
        lattices = Lattices(words)
        for batch in (p for b in batches for p in U.parts(b, "text")):
            n = batch.num_rows
            keys = batch.column("key").to_numpy().astype(np.int64).view(np.uint64)
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string())
            spaced = pc.binary_join_element_wise(lead, texts, pa.scalar("", pa.large_string()))
            pieces, sizes, before = [], np.zeros(n, np.int64), np.zeros(n, np.int64)
            for w in U.windows(spaced, words.safe, None):
                if lattices.edges > MOST_EDGES:
                    lattices.clear()
                at, new = lattices.known.add(w.h, w.v)
                for i in range(0, len(new), STEP):
                    lattices.add([w.raw(j) for j in new[i:i + STEP]])
                per_doc = np.bincount(w.doc, minlength=n)
                firsts = np.cumsum(per_doc) - per_doc
                number = np.arange(len(at)) - firsts[w.doc] + before[w.doc]
                before += per_doc
                found, count = lattices.sample(at, _mixed(keys[w.doc] + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
                found, docs = with_bytes(found, np.repeat(w.doc, count), words.byte)
                pieces.append(found)
                sizes += np.bincount(docs, minlength=n)
            flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            lossless = pc.equal(decoded(lists, words), texts.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, lossless], ["doc_id", "pieces", "lossless"])

    return run


def sample_pieces(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = 9) -> DataFrame:
    """doc_id, pieces (a sampled segmentation), and lossless: whether decoding them gives back the
    text, for every row of (doc_id, text)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return docs.select("doc_id", "text", key.alias("key")).mapInArrow(
        _encode(path or default_path("piece_bpe_32k.model"), theta), f"doc_id {kind}, pieces array<int>, lossless boolean")


def decoded(lists: pa.Array, words: Vocabulary) -> pa.Array:
    """The text of each list of pieces; empty of a null or empty list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    slot = (np.cumsum(sizes) - sizes) // (16 * STEP)
    cuts = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(sizes))
    out = [pa.array([], pa.string())]
    for a, b in zip(cuts[:-1], cuts[1:]):
        raw, per_piece = words.bytes.rows(lists[a:b].flatten().to_numpy(zero_copy_only=False))
        reach = np.append(0, np.cumsum(per_piece))
        ends = reach[np.append(0, np.cumsum(sizes[a:b]))]
        keep = np.ones(len(raw), bool)
        keep[ends[:-1][np.diff(ends) > 0]] = False  # the space in front
        offsets = np.append(0, np.cumsum(keep))[ends].astype(np.int64)
        out.append(pa.LargeStringArray.from_buffers(
            b - a, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[keep].tobytes())).cast(pa.string()))
    return pa.concat_arrays(out)


def decode_pieces(pieces: Column, path: str | None = None) -> Column:
    """The text of a column of lists of pieces."""
    path = path or default_path("piece_bpe_32k.model")

    @arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        return decoded(lists, vocabulary(path, THETA))

    return run(pieces)


def segmented(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = 9) -> DataFrame:
    """doc_id, n_pieces, pieces, and whether decoding them gives back the text, per row."""
    return sample_pieces(docs, path, theta, seed).select(
        "doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces", "lossless")

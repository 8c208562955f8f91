"""Token ids as Arrow files: equal-length sequences and their masks, read without copying.

The ids of all documents, each ended by an end id, run on in document order and are cut into
sequences of one length. A shard is two Arrow files of fixed layout: `<shard>.arrow` with
record batches of two fixed-size-list columns, `ids` and `mask` (false: padding behind the last
document of the shard; a bit each), and `<shard>.index.arrow` with doc_id, start and n_tokens of
its documents. All batches but the last hold the same number of
sequences, so sequence i is found by division; from a memory-mapped file it is read in place.

Shards are ranges of doc_id, written by one task each; a task that runs again writes new
files, and the manifest, written by Spark, names those of the attempt that counts. Files go to
any store that Arrow opens by URI. Memory per task: one batch of texts and of sequences.

Defined results: a null text is empty, and has just its end id. Null ids come first; rows with one
id are ordered by a hash of their texts. An empty table gives no shards and no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterloom.llm import units as U
from rosterloom.llm.tables import kept_as, small_batches
from rosterloom.llm.vocabularies import default_path, encoded, special_strings, tokenizer

LENGTH = 2048
BATCH = 256
MANIFEST = "shard bigint, path string, n_docs bigint, n_tokens bigint"


def document_ids(path: str, end_id: int, batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each batch of (doc_id, text): the doc ids, all token ids, and each document's number."""
    safe = U.safe_pairs(special_strings(path))
    known, pool = U.Known(), U.Pool(np.int32)
    for batch in (p for b in batches for p in U.parts(b, "text")):
        n = batch.num_rows
        ids, sizes = [], np.zeros(n, np.int64)
        for w in U.windows(batch.column("text"), safe):
            if known.n > known.most * 3 // 4:
                known.clear()
                pool.clear()
            at, new = known.add(w.h, w.v)
            for i in range(0, len(new), 8192):
                pool.extend(*encoded(path, [w.raw(j) for j in new[i:i + 8192]]))
            values, counts = pool.rows(at)
            ids.append(values)
            sizes += np.bincount(w.doc, weights=counts, minlength=n).astype(np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        yield batch.column("doc_id"), np.insert(flat, np.cumsum(sizes), end_id), sizes + 1


def _opened(path: str):
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard, a batch of sequences at a time."""

    def __init__(self, stem: str, doc_type: pa.DataType, kind, length: int = LENGTH, batch: int = BATCH):
        store, self.stem = _opened(stem)
        self.kind, self.length, self.rows = kind, length, batch
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)),
                                 ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", doc_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        if isinstance(store, fs.LocalFileSystem):
            store.create_dir(self.stem.rpartition("/")[0])
        self.files = [store.open_output_stream(f"{self.stem}{end}") for end in (".arrow", ".index.arrow")]
        self.out, self.index_out = (pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, self.index)))
        self.ids = np.zeros(0, kind)
        self.docs = self.tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        self.index_out.write_batch(pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(self.tokens + ends - sizes), pa.array(sizes)], schema=self.index))
        self.docs += len(sizes)
        self.tokens += len(ids)
        self.ids = np.append(self.ids, ids.astype(self.kind))
        step = self.length * self.rows
        full = len(self.ids) // step * step
        for i in range(0, full, step):
            self._write(self.ids[i:i + step], step)
        self.ids = self.ids[full:].copy()

    def _write(self, ids: np.ndarray, real: int) -> None:
        columns = (pa.array(ids), pa.array(np.arange(len(ids)) < real))
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns], schema=self.schema))

    def close(self) -> None:
        if len(self.ids):
            self._write(np.pad(self.ids, (0, -len(self.ids) % self.length)), len(self.ids))
        for part in (self.out, self.index_out, *self.files):
            part.close()


class Shard:
    """A shard to read from, memory-mapped where the store is a mounted one."""

    def __init__(self, stem: str):
        store, stem = _opened(stem)
        files = [f"{stem}{end}" for end in (".arrow", ".index.arrow")]
        local = isinstance(store, fs.LocalFileSystem)
        self.reader, self.index = (
            pa.ipc.open_file(pa.memory_map(f) if local else store.open_input_file(f)) for f in files)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask of sequence i, without a copy."""
        batch, row = self.reader.get_batch(i // self.rows), i % self.rows
        part = slice(row * self.length, (row + 1) * self.length)
        return (batch.column(0).values.to_numpy(zero_copy_only=True)[part],
                batch.column(1).values[part.start:part.stop])

    def documents(self) -> Iterator[tuple[object, np.ndarray]]:
        """Every document's id and token ids, one after another."""
        batches = (self.reader.get_batch(b).column(0).values.to_numpy(zero_copy_only=True)
                   for b in range(self.reader.num_record_batches))
        ids = np.zeros(0, np.int64)
        at = 0
        for b in range(self.index.num_record_batches):
            batch = self.index.get_batch(b)
            for doc_id, size in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist()):
                parts = []
                while size > len(ids) - at:
                    parts.append(ids[at:])
                    size -= len(ids) - at
                    ids, at = next(batches), 0
                parts.append(ids[at:at + size])
                at += size
                yield doc_id, np.concatenate(parts) if len(parts) > 1 else parts[0]


def _write_shard(folder: str, path: str, end_id: int, length: int, kind):
    def run(batches):
        writer, part = None, TaskContext.get().partitionId()
        stem = f"{folder}/{part:06d}-{uuid.uuid4().hex}"
        for doc_ids, ids, sizes in document_ids(path, end_id, batches):
            if writer is None:
                writer = ShardWriter(stem, doc_ids.type, kind, length)
            if len(sizes):
                writer.add(doc_ids, ids, sizes)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (part, stem, writer.docs, writer.tokens)],
                ["shard", "path", "n_docs", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1,
                      length: int = LENGTH) -> DataFrame:
    """Writes (doc_id, text) into shards below `folder`, and returns their manifest."""
    path = path or default_path("word_bpe_49k.json")
    kind = np.uint16 if tokenizer(path).get_vocab_size() <= 1 << 16 else np.uint32
    small_batches(docs.sparkSession)
    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return kept_as(ranged.mapInArrow(_write_shard(f"{folder}/shards", path, end_id, length, kind), MANIFEST),
                   f"{folder}/manifest")


def _read_shard(batches):
    for batch in batches:
        for stem, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
            rows: list[tuple] = []
            shard = Shard(stem)
            doc_type = shard.index.schema.field("doc_id").type

            def out():
                ids, starts, sizes, sums = zip(*rows)
                return pa.RecordBatch.from_arrays(
                    [pa.array(ids, doc_type), *[pa.array(x, pa.int64()) for x in (starts, sizes, sums)]],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

            for doc_id, ids in shard.documents():
                rows.append((doc_id, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                first += len(ids)
                if len(rows) == 8192:
                    yield out()
                    rows.clear()
            if rows:
                yield out()


def read_token_files(spark: SparkSession, manifest: DataFrame, doc_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the shards.

    Where a shard starts is the sum of those before it: a window over one row per shard.
    """
    before = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")
    shards = manifest.filter("n_docs > 0").select("path", before.alias("first"))
    # A task per shard: so many were given, since Spark would join what looks small to it.
    return shards.repartition(max(manifest.count(), 1)).mapInArrow(
        _read_shard, f"doc_id {doc_type}, start bigint, n_tokens bigint, ids_crc32 bigint")

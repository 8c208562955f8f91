"""Token counts without token ids: pieces are counted once per distinct pre-token.

A pre-token here is a unit of `units`: a stretch that the tokenizer treats alone. Three steps:
the frequency of every pre-token over all texts; its pieces, counted once by the library; then
per document the frequencies of its pre-tokens, joined to the pieces and summed. Most of what a
text holds are the same frequent pre-tokens, so their counts (at most `head` of them, of at
most 64 bytes each: a few MB) go to every worker and are joined there; all other pre-tokens
are joined by a shuffle. Both joins are exact.

Defined results: a null text is empty and has 0 bytes and 0 tokens. Rows with the same or a null
id are counted one by one. Special strings inside texts count as the library counts them by
default. An empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm import units as U
from rosterloom.llm.tables import kept_as, small_batches
from rosterloom.llm.vocabularies import default_path, encoded, special_strings
from rosterloom.workspace import work_folder

HEAD = 1 << 18
HEAD_BYTES = 64


def _frequencies(path: str):
    def run(batches):
        known, counts, raw = U.Known(), np.zeros(0, np.int64), []

        def flush():
            if raw:
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(counts[:known.n])], ["unit", "n"])

        safe = U.safe_pairs(special_strings(path))
        for batch in (p for b in batches for p in U.parts(b, "text")):
            for w in U.windows(batch.column(0), safe):
                at, new = known.add(w.h, w.v)
                raw.extend(w.raw(i) for i in new)
                counts = U._room(counts, known.n)
                counts[:known.n] += np.bincount(at, minlength=known.n)
                if known.n > 1 << 19:
                    yield from flush()
                    known.clear()
                    counts, raw = np.zeros(0, np.int64), []
        yield from flush()

    return run


def _pieces(path: str):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                _, n = encoded(path, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n)], ["unit", "n", "pieces"])

    return run


def pretoken_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(unit, n, pieces): every distinct pre-token, how often it occurs, and its pieces."""
    found = docs.select("text").mapInArrow(_frequencies(path), "unit binary, n bigint")
    totals = found.groupBy("unit").agg(F.sum("n").alias("n"))
    return totals.mapInArrow(_pieces(path), "unit binary, n bigint, pieces bigint")


def most_frequent(vocabulary: DataFrame, head: int) -> DataFrame:
    """(unit, pieces) of the most frequent pre-tokens, at most `head`.

    Chosen by a least frequency, from the numbers of pre-tokens per eighth of a power of two (a few
    hundred rows): a sort would bring `head` rows of every partition to one task.
    """
    step = F.floor(F.log2("n") * 8).alias("step")
    least, total = None, 0
    for row in vocabulary.groupBy(step).count().orderBy(F.desc("step")).collect():
        total += row["count"]
        if total > head:
            break
        least = row["step"]
    if least is None:
        return vocabulary.select("unit", "pieces").limit(0)
    return vocabulary.filter(step >= least).select("unit", "pieces")


def _per_document(path: str, head):
    def run(batches):
        h, v, pieces = head.value
        known, safe = U.Known(), U.safe_pairs(special_strings(path))
        at, _ = known.add(h, v)
        worth = np.zeros(known.n + 1, np.int64)
        worth[at] = pieces
        row = TaskContext.get().partitionId() << 33
        for batch in (p for b in batches for p in U.parts(b, "text")):
            texts, n = batch.column("text"), batch.num_rows
            total = np.zeros(n, np.int64)
            rest: list[dict] = [{} for _ in range(n)]
            for w in U.windows(texts, safe):
                at = known.find(w.h, w.v)
                total += np.bincount(w.doc, weights=worth[at], minlength=n).astype(np.int64)
                for i in np.flatnonzero(at < 0):
                    mine, unit = rest[w.doc[i]], w.raw(i)
                    mine[unit] = mine.get(unit, 0) + 1
            ends = np.cumsum([0, *map(len, rest)]).astype(np.int32)
            flat = pa.StructArray.from_arrays(
                [pa.array([u for r in rest for u in r], pa.binary()),
                 pa.array([c for r in rest for c in r.values()], pa.int64())], ["unit", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(row + np.arange(n)),
                 pa.array(total), pa.ListArray.from_arrays(pa.array(ends), flat)],
                ["doc_id", "n_bytes", "row", "head", "rest"])
            row += n

    return run


def token_counts(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of (doc_id, text)."""
    path = path or default_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    vocabulary = kept_as(pretoken_pieces(docs, path), work_folder(spark, "pretokens"))
    frequent = most_frequent(vocabulary.filter(F.octet_length("unit") <= HEAD_BYTES), head).toArrow()
    known = (*U.hashes_of(frequent["unit"].to_pylist()), frequent["pieces"].to_numpy())
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = kept_as(
        docs.mapInArrow(_per_document(path, spark.sparkContext.broadcast(known)),
                        f"doc_id {kind}, n_bytes bigint, row bigint, head bigint, "
                        "rest array<struct<unit: binary, n: bigint>>"),
        work_folder(spark, "pretokens-by-document"))
    rest = rows.select("row", F.inline("rest")).join(vocabulary.select("unit", "pieces"), "unit")
    sums = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_bytes", (F.col("head") + F.coalesce("more", F.lit(0))).alias("n_tokens"))

"""Mixing sources to target weights: each document is repeated or left out by its source's rate.

Everything here is DataFrame functions. Rows are never collected; the driver sees a few sums.

Defined results: a null text has size 0. A null source is a source like any other and comes
last. A source without words gets target 0 and rate 0. Rows with the same id (nulls too)
draw the same number, so repeated rows are taken alike. An empty table gives no rows.
Columns of the input whose names clash with those used here stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.llm.tables import kept_as, same, unused, word_count
from rosterloom.workspace import work_folder

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank): sources by code point, null last, from 0.

    Sorting by ranges and counting the rows per range ranks any number of sources without
    bringing them together in one task.
    """
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    totals = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    placed = kept_as(
        totals.repartitionByRange(order).sortWithinPartitions(order)
        .withColumn("place", F.monotonically_increasing_id()), work_folder(spark, "sources"))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.withColumn("part", part).join(before, "part").select(
        "source", "source_size", (F.col("before") + at).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources weigh `weights`, repeating, and share `share` times all sizes. A target stops at
    `most` times its source's size; the others share the rest by weight until none is above.
    The level per weight rises from round to round until no further source stops.
    """
    if not 0 <= share <= most:
        raise ValueError("the share of all sizes must be between 0 and the most of each")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    sources = kept_as(ranked_sources(sizes).select(
        "source", "source_size", F.get(listed, (F.col("rank") % len(weights)).cast("int")).alias("weight")),
        work_folder(sizes.sparkSession, "weights"))
    limit = F.col("source_size") * F.lit(float(most))
    level, before = 0.0, None
    while level != before:
        stopped = limit <= F.col("weight") * F.lit(level)
        sums = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(stopped, F.col("source_size"))).alias("stopped"),
            F.sum(F.when(~stopped, F.col("weight"))).alias("weight")).first()
        if not sums["weight"]:
            break
        before, level = level, max(level, (share * sums["all"] - most * (sums["stopped"] or 0)) / sums["weight"])
    fair = F.col("weight") * F.lit(level)
    return sources.select("source", "source_size", F.when(limit <= fair, limit).otherwise(fair).alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number from 0 up to 1, from the key and the seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                most: float = MOST, seed: int = 10) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with size, source_size, target and copies of each row; and how these columns
    are called here.

    copies is the whole part of the rate (target by source size), and one more with the
    fraction as its probability. Spark broadcasts the sources only while their table is
    within its limit; else it joins by source and splits large ones.
    """
    names = {c: unused(c, docs) for c in ("size", "source_size", "target", "copies")}
    targets = source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, share, most)
    key = unused("key", docs)
    targets = targets.select(F.col("source").alias(key), F.col("source_size").alias(names["source_size"]),
                             F.col("target").alias(names["target"]))
    sized = docs.withColumn(names["size"], word_count(F.col("text")))
    joined = sized.join(targets, same(sized["source"], targets[key])).drop(key)
    rate = F.coalesce(F.try_divide(names["target"], names["source_size"]), F.lit(0.0))
    extra = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("bigint")
    return joined.withColumn(names["copies"], F.floor(rate) + extra), names


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the rows of `docs`, each as often as the mix takes it."""
    mixed, names = with_copies(docs, **options)
    times = F.col(names["copies"]).cast("int")
    copy = unused("copy", mixed)
    repeated = mixed.filter(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: size, source_size, target and the words the mix takes of it."""
    mixed, names = with_copies(docs.select("doc_id", "source", "text"), **options)
    return mixed.select("doc_id", *[F.col(names[c]).alias(c) for c in ("size", "source_size", "target")],
                        (F.col(names["size"]) * F.col(names["copies"])).alias("taken"))

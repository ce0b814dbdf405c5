"""A deterministic mix of sources: golden-ratio points choose sources, ranked slots take equal-token blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut, row_key, running_offsets

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)

#: A source is taken at most so many times.
MOST_PASSES = 3

#: Slots of a schedule for its larger sources; a block has so many words that the corpus fills them.
SLOTS = 1_000_000

#: A source has so many blocks at least, or one for each word.
LEAST_BLOCKS = 1000

#: Documents that one ordered run of a source holds on average.
ROWS_PER_RUN = 256

#: Cells of [0, 1) in which points meet shares.
CELLS = 4096

#: Up to so many sources their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000

#: floor(2^64 / golden ratio) shifted to 52 bits: the steps of the additive golden-ratio sequence, exact in integers.
GOLDEN = 0x9E3779B97F4A7C15 >> 12


def n_words(text: Column) -> Column:
    """Maximal runs of characters other than space and 0x09 to 0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Targets share the total by weight; one that would pass ``most`` times its source's size stops
    there and its excess is reshared by weight: target = min(cap, weight * level), with the level
    that spends the total. Sources are few against documents; only this table is ordered globally.
    """
    one = Window.partitionBy(F.lit(0))
    by_source = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    t = (
        sizes.withColumn("w", F.get(table, F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights)))))
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("total", F.sum("source_size").over(one))
    )
    up = one.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open_w", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_w"))
    # the first source, in order of cap / weight, that its level does not lift above its cap
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(one)["level"])
    return t.select("source", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(slot, source, rank) from (source, points): slot i goes to the source whose share of points holds the i-th golden-ratio point.

    rank counts a source's slots from 0. It is computed over runs of slots, in parallel.
    """
    one = Window.partitionBy(F.lit(0))
    by = one.orderBy(F.col("source").asc_nulls_last())
    share = targets.filter("points > 0").withColumn("hi", F.sum("points").over(by) / F.sum("points").over(one))
    share = share.select("source", F.lag("hi", 1, 0.0).over(by).alias("lo"), F.when(F.lead("hi").over(by).isNull(), 1.0).otherwise(F.col("hi")).alias("hi"))
    # shares meet points in cells of [0, 1), so that the join is on equal cells and holds for many sources
    cells = share.withColumn("cell", F.explode(F.sequence((F.col("lo") * CELLS).cast("int"), F.least((F.col("hi") * CELLS).cast("int"), F.lit(CELLS - 1)))))
    point = F.pmod(F.col("id").cast("decimal(19,0)") * F.lit(GOLDEN).cast("decimal(16,0)"), F.lit(1 << 52).cast("decimal(16,0)"))
    drawn = targets.sparkSession.range(slots).select(F.col("id").alias("slot"), (point.cast("double") / float(1 << 52)).alias("u"))
    drawn = drawn.withColumn("cell", (F.col("u") * CELLS).cast("int")).join(cells, "cell").filter("lo <= u and u < hi")
    drawn = drawn.select("slot", "source", F.shiftright("slot", 12).alias("run"))
    keyed = drawn.withColumn("k", F.struct("source"))
    starts = running_offsets(keyed, "k", "run", F.lit(1), "before")
    w = Window.partitionBy("k", "run").orderBy("slot")
    return (
        keyed.withColumn("r", F.row_number().over(w) - 1)
        .join(starts, ["k", "run"])
        .select("slot", "source", (F.col("before") + F.col("r")).cast("long").alias("rank"))
    )


def by_source(targets: DataFrame) -> DataFrame:
    """The table of sources, marked for broadcast if its rows, counted, are few."""
    return F.broadcast(targets) if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else targets


def segments(docs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Documents of (source, size, width, ...) laid end to end in a shuffled order of each source and cut into blocks of ``width`` words.

    Adds ``start`` (words of the source before the document), ``block`` and ``words`` (of this document in
    the block). The order is that of a hash of the columns ``order``, so reruns agree; ordered runs and the sums before them replace
    one long window, so that a source with a third of all rows is still many tasks.
    """
    cols = docs.columns
    runs = max(1, docs.count() // ROWS_PER_RUN)
    keyed = docs.withColumn("h", F.xxhash64(*order)).withColumn("k", F.struct("source")).withColumn("run", F.pmod("h", F.lit(runs)))
    starts = running_offsets(keyed, "k", "run", F.col("size"), "before")
    w = Window.partitionBy("k", "run").orderBy("h", *order)
    laid = keyed.withColumn("within", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    laid = laid.join(starts, ["k", "run"]).withColumn("start", (F.col("before") + F.col("within")).cast("long"))
    first, last = F.expr("start div width"), F.expr("greatest(start, start + size - 1) div width")
    cutup = laid.select(*cols, "start", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("width")) - F.greatest("start", F.col("block") * F.col("width"))
    return cutup.withColumn("words", words.cast("long"))


def block_sizes(targets: DataFrame, slots: int | None = None) -> DataFrame:
    """targets with ``width``, the words of a source's blocks, ``blocks`` and ``points``, the slots that its target asks for.

    Blocks have so many words that the corpus fills ``SLOTS``, but a source is cut into ``LEAST_BLOCKS`` at least, or into
    words, and its points count its last block as what it holds, so that small sources meet their targets beside large ones.
    With ``slots``, all sources have blocks of one size.
    """
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    common = F.lit(max(1, -(-total // (slots or SLOTS)))).cast("long")
    width = common if slots else F.least(common, F.greatest(F.lit(1), F.expr(f"source_size div {LEAST_BLOCKS}")))
    t = targets.withColumn("width", width).withColumn("blocks", F.expr("(source_size + width - 1) div width"))
    each = F.lit(1.0) / F.col("width") if slots else F.col("blocks") / F.col("source_size")
    return t.withColumn("points", F.when(F.col("blocks") > 0, F.col("target") * each).otherwise(0.0))


def mix(docs: DataFrame, order: Sequence[str], weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces, targets) for docs with (source, size, ...): pieces of documents in the mix, one row each.

    ``order`` names the columns whose hash shuffles a source; rows that agree in them are interchangeable.

    A piece has the columns of docs, ``width``, ``start``, ``block``, ``words``, ``slot`` (its place in the mix) and
    ``turn`` (0 for the first time that its block is taken). The r-th slot of a source takes its block r modulo
    its blocks, so takes are as even as can be; a source's slots stop at ``most`` whole turns. ``slots`` is as in ``block_sizes``.
    """
    docs = cut(docs)
    targets = source_targets(docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, most)
    targets = cut(block_sizes(cut(targets), slots))
    n = math.ceil(round(targets.agg(F.sum("points")).first()[0] or 0.0, 6))
    sizes = by_source(targets.select(F.struct("source").alias("k"), "width"))
    pieces = segments(docs.withColumn("k", F.struct("source")).join(sizes, "k").drop("k"), order)
    plan = schedule(targets, n).withColumn("k", F.struct("source"))
    plan = plan.join(by_source(targets.select(F.struct("source").alias("k"), "blocks")), "k").filter(F.col("rank") < F.col("blocks") * most)
    plan = plan.select("k", "slot", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").cast("int").alias("turn"))
    taken = pieces.withColumn("k", F.struct("source")).join(plan, ["k", "block"]).drop("k")
    return taken, targets


def mix_report(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, slots: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of documents.

    Null or empty texts have size 0 and are taken 0 times; null sources form one source, ordered last;
    repeated rows each get a result; other columns are ignored; no rows give no rows.
    """
    slim = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.crc32("text").alias("crc"), F.monotonically_increasing_id().alias("row")))
    taken, targets = mix(slim, ["doc_id", "source", "size", "crc"], weights, most, slots)
    words = taken.groupBy("row").agg(F.sum("words").alias("taken"))
    known = by_source(targets.select(F.struct("source").alias("k"), "source_size", "target"))
    return (
        slim.withColumn("k", F.struct("source"))
        .join(known, "k")
        .join(words, "row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, slots: int | None = None) -> DataFrame:
    """The mix in whole documents, with the columns of docs: a document comes once for each take of its first word.

    A document without words goes with the block at whose start or inside which it lies. Rows are told apart by all
    their columns, nulls and where they stand included; rows that agree in all share their takes evenly.
    """
    at = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.withColumnsRenamed(at)
    keyed = plain.select(
        F.struct(*plain.columns).alias("doc"),
        F.col(at["source"]).alias("source"),
        n_words(F.col(at["text"])).alias("size"),
        row_key(plain).alias("row"),
    )
    slim = keyed.groupBy("source", "size", "row").agg(F.count("*").cast("int").alias("rows"))
    slim = cut(slim.select("source", "size", "row", "rows", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")))
    taken, _ = mix(slim, ["source", "size", "row", "copy"], weights, most, slots)
    takes = taken.filter(F.col("block") == F.expr("start div width")).groupBy("source", "size", "row", "rows").agg(F.count("*").alias("takes")).drop("source", "size")
    # repeated rows share their takes evenly; ordering by the join key asks for no further sort
    nth = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    out = keyed.select("doc", "row").join(takes, "row").withColumn("nth", nth)
    out = out.withColumn("n", (F.expr("takes div rows") + F.when(F.col("nth") <= F.expr("takes % rows"), 1).otherwise(0)).cast("int"))
    return out.filter("n > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*[F.col(f"doc.{v}").alias(k) for k, v in at.items()])

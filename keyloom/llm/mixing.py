"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WORD, distributed_rank, materialize, null_safe_join, scratch


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, size)``.

    Sources in code-point order (null last) weigh ``weights`` in turn and share the total size; a
    target stops at ``cap`` times its source's size and the excess is reshared by weight.  That fixed
    point is a water level: sources ordered by cap/weight fill first, and the first one that its
    share does not fill gives the level of all that follow.  The windows see one row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(by_name) - 1) % len(weights)
    t = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (index + 1).cast("int")))
    t = t.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("most"))
    t = t.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("level") * F.col("w"))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def _fraction(hexed: Column) -> Column:
    """The first 32 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """Copies of each document in a mix: (doc_id, source, size, source_size, target, copies, taken).

    Within a source each document is expected ``target / source_size`` times.  Documents are ranked
    by (size, digest of doc_id), so the prefix sum at rank r is r times that rate; with one random
    offset a source (from ``seed``), a document is emitted once for each integer that its step of the
    prefix sum crosses.  Ranking by size makes the words taken follow the target to within about
    one of the largest documents.  Reruns agree.  Ranks are distributed (see ``distributed_rank``).

    Null or empty text: size 0, taken 0.  Null source: a source of its own, last.  Sources of size 0
    get target 0 and no copies.  Very long texts: whole, one document each.  Repeated doc_ids and rows
    are documents of their own.  Ties in size follow a digest of doc_id; rows that tie there too are
    alike.  Other columns are not read, so none clashes.  Empty input: empty result.
    """
    with scratch(docs.sparkSession):
        return materialize(_mix(docs, size, weights, cap, seed), "mixed", keep=True)


def _mix(docs: DataFrame, size: Column | None, weights: tuple[int, ...], cap: float, seed: int, carried: tuple[str, ...] = ()) -> DataFrame:
    size = word_count(docs["text"]) if size is None else size
    base = docs.select("doc_id", "source", size.cast("long").alias("size"), *carried)
    base = materialize(base.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), "mix")
    targets = source_targets(base, weights, cap)
    rate = F.col("target") / F.col("source_size")
    start = _fraction(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\0null")))))
    targets = targets.withColumn("_rate", F.when(F.col("source_size") > 0, rate).otherwise(0.0)).withColumn("_u", start)
    ranked = distributed_rank(base, ["source"], ["size", "_h", "doc_id", *carried], "_rank")
    joined = null_safe_join(ranked, targets, ["source"])

    # one integer boundary crossed, one copy
    crossed = F.floor(F.col("_rank") * F.col("_rate") + F.col("_u")) - F.floor((F.col("_rank") - 1) * F.col("_rate") + F.col("_u"))
    joined = joined.withColumn("copies", F.least(crossed, F.ceil("_rate")).cast("long"))
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", *carried).withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: each document repeated ``copies`` times, with the columns of ``docs``.

    Rows are numbered and meet their copies by number, so repeated and null doc_ids are documents of
    their own here too.  Other columns pass unread, whatever their names but ``__mix_...``; odd rows
    are as for ``mix``.  Texts meet the plan the same way at every size; the built side is unique
    numbers, dealt evenly by hash.
    """
    size = word_count(docs["text"]) if size is None else size
    numbered = materialize(docs.withColumns({"__mix_row": F.monotonically_increasing_id(), "__mix_size": size}), "numbered")
    with scratch(docs.sparkSession):
        plan = _mix(numbered, F.col("__mix_size"), weights, cap, seed, ("__mix_row",)).filter("copies > 0")
        plan = materialize(plan.select(F.col("__mix_row").alias("__mix_id"), F.col("copies").cast("int").alias("__mix_copies")), "mixed", keep=True)
    joined = numbered.join(plan.hint("shuffle_hash"), F.col("__mix_row") == F.col("__mix_id"))
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[numbered[c] for c in docs.columns])

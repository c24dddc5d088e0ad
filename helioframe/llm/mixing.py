"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key: minus the logarithm of a uniform number, divided by the document's quality
weight. The smallest keys of a source are a sample without replacement in which a heavier document comes earlier. A
source's target in words is taken as complete epochs first; the rest of the target is filled by the documents of the
source in the order of their keys, until the running sum of their sizes reaches it. The document at the cut gives only
the words that are still missing, so a source ends within one word of its target.

No source is ever sorted as a whole: the place of the cut is found by histograms of the keys (words per bin and source),
each one inside the bin of the one before, until so few documents are left that ordering them is cheap. Documents
beyond the cut's bin only compare their key with it. Equal keys belong to repeated rows; if very many of them lie at the
cut, they are numbered by the partitions in which they stand.

The uniform number is a hash of the seed, the id and the text: reruns agree, and no row depends on its partition.

Defined cases: a null or empty text has no words, is in the mix and takes nothing; a null source is a source, the last
one; a weight that is null, not a number or below ``LEAST_WEIGHT`` counts as that; repeated rows count as often as they
occur; an empty table gives an empty mix; columns that are not carried do not matter, and a carried one that is
called like a result gives way to the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.common import written

#: Bins of one histogram, and rows of one source that may be ordered in one group.
BINS, FEW = 1024, 2_000
#: Sources up to which the table of cuts (one row a source) is broadcast.
FEW_SOURCES = 100_000
LEAST_WEIGHT = 0.1
RESULTS = ("size", "source_size", "target", "taken")


def words(text: str = "text") -> Column:
    """Number of runs of anything but space and the five ASCII control blanks."""
    marks = F.regexp_replace(F.col(text).cast("string"), r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("bigint")


def letter_share(text: str = "text") -> Column:
    """A plain quality weight: the share of letters in the text, at least ``LEAST_WEIGHT``."""
    col = F.col(text).cast("string")
    letters = F.length(F.regexp_replace(col, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    return F.when(F.length(col) > 0, F.greatest(F.lit(LEAST_WEIGHT), letters / F.length(col))).otherwise(LEAST_WEIGHT)


def exponential_key(doc_id: str, text: str, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash of seed, id and text."""
    col = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), name, col).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    sound = F.when(weight >= LEAST_WEIGHT, F.when(~F.isnan(weight), weight))
    return -F.log(u) / F.coalesce(sound, F.lit(LEAST_WEIGHT))


def source_targets(
    facts: DataFrame, source_weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """One row per source: ``source_size``, ``target``, number of rows and range of keys.

    The targets share ``share`` times all words by weight and stop at ``most`` times the source; what a source cannot
    take goes to the others by weight. That is one water level: target = min(most * size, level * weight), found in
    one pass over the sources in the order in which they fill up.
    """
    sums = facts.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.count(F.lit(1)).alias("rows"),
        F.min("key").alias("low"),
        F.max("key").alias("high"),
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    listed = F.array(*[F.lit(float(w)) for w in source_weights])
    sources = sums.withColumn("place", place).withColumn(
        "weight", F.element_at(listed, (F.col("place") - 1) % len(source_weights) + 1)
    )
    sources = sources.withColumn("cap", F.col("source_size") * float(most))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = fills.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * float(share)
    levels = sources.withColumn("order", F.row_number().over(fills)).withColumn("level", (budget - before) / open_weight)
    first_open = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("order", "level"))).over(everything)
    return levels.withColumn("open", first_open).select(
        "source",
        "source_size",
        F.when(F.col("order") >= F.col("open.order"), F.col("open.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"),
        "rows",
        "low",
        "high",
    )


def _beside(rows: DataFrame, few: DataFrame, n: int) -> DataFrame:
    """``rows`` with the columns of their source; the table of sources travels to them while it is small."""
    side = few.withColumnRenamed("source", "_of")
    side = F.broadcast(side) if n <= FEW_SOURCES else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("_of")), "inner").drop("_of")


def _narrowed(facts: DataFrame, cuts: DataFrame, n: int, few: int) -> DataFrame:
    """The cuts, with the range of keys of each crowded source narrowed to the bin in which its cut lies."""
    crowded = (F.col("rows") > few) & (F.col("low") < F.col("high"))
    at = F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)
    bins = (
        _beside(facts, cuts.where(crowded), n)
        .where(F.col("key").between(F.col("low"), F.col("high")))
        .groupBy("source", at.alias("bin"))
        .agg(
            F.sum("size").alias("words"),
            F.count(F.lit(1)).alias("rows"),
            F.min("key").alias("low"),
            F.max("key").alias("high"),
            F.first("before").alias("before"),
            F.first("rest").alias("rest"),
        )
    )
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = bins.withColumn("reached", F.col("before") + F.sum("words").over(upto))
    found = summed.where((F.col("reached") >= F.col("rest")) & (F.col("reached") - F.col("words") < F.col("rest"))).select(
        "source",
        (F.col("reached") - F.col("words")).alias("_before"),
        F.col("rows").alias("_rows"),
        F.col("low").alias("_low"),
        F.col("high").alias("_high"),
    )
    moved = {c: F.col(f"_{c}") for c in ("before", "rows", "low", "high")}
    fresh = _beside(cuts, found, n).withColumns(moved).select(*cuts.columns)
    return cuts.where(~crowded).unionByName(fresh)


def _at_the_cut(edge: DataFrame, few: int) -> DataFrame:
    """Running sums of the documents around the cuts.

    Few documents of a source are ordered by key. More than that have one key only, and are copies: they are numbered
    within the partitions of the written table, behind the words of the partitions before.
    """
    order = Window.partitionBy("source").orderBy("key", "size")
    small = edge.where(F.col("rows") <= few).withColumn(
        "upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    copies = edge.where(F.col("rows") > few)
    groups = copies.groupBy("source", "size", "_part").agg((F.count(F.lit(1)) * F.col("size")).alias("_words"))
    earlier = Window.partitionBy("source").orderBy("size", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(
        F.col("source").alias("_of"),
        F.col("size").alias("_size"),
        F.col("_part").alias("_in"),
        F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start"),
    )
    number = F.row_number().over(Window.partitionBy("source", "size", "_part").orderBy("key"))
    counted = (
        copies.withColumn("_number", number)
        .join(
            starts,
            F.col("source").eqNullSafe(F.col("_of")) & (F.col("size") == F.col("_size")) & (F.col("_part") == F.col("_in")),
        )
        .withColumn("upto", F.col("before") + F.col("_start") + F.col("_number") * F.col("size"))
    )
    return small.unionByName(counted.select(*small.columns))


def mixed(
    docs: DataFrame,
    size: Column | None = None,
    weight: Column | None = None,
    source_weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    carry: Sequence[str] = ("doc_id",),
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = "mix",
    few: int = FEW,
) -> DataFrame:
    """The mix: the carried columns of every document, ``source``, its ``size``, its source's ``source_size`` and
    ``target``, and ``taken``, the words that the mix takes of it: complete epochs and what the fractional selection adds.

    ``source_weights`` belong to the sources in code point order, repeating. Texts are best left out of ``carry`` and
    joined to the result by id, since carried columns are written once in the checkpoint folder.
    """
    kept = {c: f"_carried{i}" for i, c in enumerate(c for c in carry if c not in (*RESULTS, "source"))}
    facts = written(
        docs.select(
            *[F.col(c).alias(n) for c, n in kept.items()],
            F.col(source).alias("source"),
            (words(text) if size is None else size).alias("size"),
            exponential_key(doc_id, text, letter_share(text) if weight is None else weight, seed).alias("key"),
            F.spark_partition_id().alias("_part"),
        )
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    cuts = source_targets(facts, source_weights, share, most).withColumn("epochs", epochs)
    cuts = cuts.withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    # A source without a fractional epoch has no cut: nothing lies below it or at it.
    for c, none in (("low", F.lit(-1.0)), ("high", F.lit(-1.0)), ("rows", F.lit(0))):
        cuts = cuts.withColumn(c, F.when(F.col("rest") > 0, F.col(c)).otherwise(none))
    cuts = written(cuts.withColumn("before", F.lit(0).cast("bigint")))
    n = cuts.count()
    while cuts.where((F.col("rows") > few) & (F.col("low") < F.col("high"))).limit(1).count():
        cuts = written(_narrowed(facts, cuts, n, few))

    placed = _beside(facts, cuts, n)
    edge = _at_the_cut(placed.where(F.col("key").between(F.col("low"), F.col("high"))), few)
    clear = placed.where(~F.col("key").between(F.col("low"), F.col("high"))).withColumn(
        "upto", F.when(F.col("key") < F.col("low"), F.col("rest"))
    )
    left = F.col("rest") - F.col("upto") + F.col("size")
    partial = F.when(left > 0, F.least("size", left)).otherwise(F.lit(0))
    taken = F.col("epochs") * F.col("size") + partial
    return clear.unionByName(edge.select(*clear.columns)).select(
        *[F.col(n).alias(c) for c, n in kept.items()], "source", "size", "source_size", "target", taken.alias("taken")
    )

"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document owes ``target / source
size`` copies: the whole part is certain, the rest is an inclusion probability,
which no document has beyond the words that its source lacks. Documents are ranked by the odds of a random number divided by their inclusion
odds, and each source takes the front of its ranking until the words that are
still missing are taken (the sample's size is fixed in words, so long documents
do not throw it off its target).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, text_of, unit_hash, written

#: Ranking bins of a source; only the bin in which its target falls is sorted.
BINS = 4096


def words_in(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, n, source_size, target`` of ``sizes(source, n, source_size)``.

    Sources in code point order (null last) weigh ``weights`` in turn and share
    ``share`` of all sizes. A target stops at ``most`` times its source and the
    excess is reshared by weight until none is above, which is water filling:
    in order of the level at which a source fills, all before the first source
    that stays below are full and the rest divide what is left by weight.
    One row a source, so the windows over all sources stay small.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (pick + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(most)).withColumn("fills_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("fills_at", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = (
        weighed.withColumn("pool", F.sum("source_size").over(everything) * float(share))
        .withColumn("left", F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
    )
    # The first source whose own level is below its filling point fixes the level of all that follow.
    first = F.min(F.when(F.col("level") < F.col("fills_at"), F.struct("fills_at", F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    fixed = weighed.withColumn("level_of_all", first)
    target = F.least(F.col("cap"), F.coalesce(F.col("level_of_all") * F.col("weight"), F.col("cap")))
    return fixed.select("source", "n", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col, size, source_size, target, taken, copies`` of every row of ``docs``.

    ``taken`` is the words the mix takes of the row, repeats counted: its size
    times its certain copies, once more if it is sampled. Null texts have size
    0, a null source is a source, repeated rows are rows (equal ones share
    their random number and are told apart by nothing, so either may be taken).
    Columns of ``keep`` come along; others are ignored. An empty table gives an empty result. The random
    numbers hash id, source, size and seed, so reruns agree.
    """
    light = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words_in(text_of(text_col)).alias("size"), *keep)
    light = written(light, "mix-sizes")
    sums = light.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    goal = written(targets(sums, weights, share, most), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(ratio + F.lit(1e-12))).withColumn("part", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    goal = goal.withColumn("need", F.col("part") * F.col("source_size")).withColumnRenamed("source", "of")
    rows = light.join(goal.drop("n"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    u = unit_hash(F.lit(seed), F.col("id"), F.coalesce("source", F.lit("\0")), F.col("size"))
    # a document's inclusion probability: its source's share, less where the document alone is more than the source lacks
    p = F.least(F.col("part"), F.when(F.col("size") > 0, F.col("need") / F.col("size")).otherwise(F.col("part")))
    odds = (u / (1 - u)) / (p / (1 - p))
    # Odds over odds are mapped to (0, 1) so that they can be binned; the order is kept.
    rows = rows.withColumn("rank_key", F.when(F.col("part") > 0, odds / (1 + odds)).otherwise(F.lit(1.0)))
    rows = rows.withColumn("bin", F.least(F.floor(F.col("rank_key") * BINS), F.lit(BINS - 1)).cast("int"))
    rows = written(_front(rows.withColumn("extra", F.lit(False)), whole_only=True), "mix-front")
    # What one long document at the crossing left open goes to later documents that fit.
    got = rows.groupBy("source").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("got"))
    got = written(got.withColumnRenamed("source", "of"), "mix-got")
    rows = rows.join(got, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rows = _front(rows.withColumn("need", F.col("need") - F.col("got")).drop("got"), whole_only=False)
    copies = (F.col("whole") + F.col("extra").cast("long")).cast("long")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * copies).alias("taken"), copies.alias("copies"), *keep)


def _front(rows: DataFrame, whole_only: bool) -> DataFrame:
    """Sets ``extra`` for the front of each source's ranking that fills ``need``.

    Candidates are rows not yet taken. The running sum goes over bins of the
    rank first; only the bin where it crosses the need is sorted row by row.
    With ``whole_only`` the sum stays below the need; the pass after it fills
    what one long document at the crossing left open with those that fit, and
    ends at the document boundary nearest to the need.
    """
    free = ~F.col("extra") & (F.col("part") > 0)
    free = free if whole_only else free & (F.col("size") <= F.col("need"))
    bins = rows.where(free).groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("need").alias("need"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cross = bins.withColumn("after", F.sum("bin_size").over(run)).where(F.col("after") > F.col("need"))
    cross = cross.groupBy(F.col("source").alias("of")).agg(F.min(F.struct("bin", (F.col("after") - F.col("bin_size")).alias("before"))).alias("x"))
    # a row a source: its size is known once written, so the join broadcasts it where it is small
    cross = written(cross.select("of", F.col("x.bin").alias("at"), F.col("x.before").alias("before")), "mix-cross")
    rows = rows.withColumn("free", free).join(cross, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    edge = F.col("free") & F.coalesce(F.col("bin") == F.col("at"), F.lit(False))
    inside = Window.partitionBy("source", "bin").orderBy("rank_key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clear = rows.where(~edge).withColumn("extra", F.col("extra") | (F.col("free") & (F.col("at").isNull() | (F.col("bin") < F.col("at")))))
    upto = F.col("before") + F.sum("size").over(inside) - (0 if whole_only else F.col("size") / 2)
    close = rows.where(edge).withColumn("upto", upto)
    close = close.withColumn("extra", F.col("upto") <= F.col("need")).drop("upto")
    return clear.unionByName(close).drop("free", "at", "before")

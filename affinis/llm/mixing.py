"""Mixing sources to target weights.

Words are summed per source, targets are found by filling up to each source's cap, and each document is
emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.

Defined results: a null text has no words; a null source is a source of its own, ordered last; documents
with equal ids share their draw, so repeated rows are taken alike; an empty table gives an empty result;
sources without words get the target 0; other columns of the input never clash with those made here,
because a row travels as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import WORD, cut, full_text

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix has SHARE[0] / SHARE[1] times all words; a target has at most CAP times its source's words.
SHARE, CAP = (3, 2), 2
#: Up to so many sources (some 10 MB) the targets are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
SEED = 20


def n_words(text: Column) -> Column:
    return F.regexp_count(full_text(text), F.lit(WORD)).cast("long")


def draw(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest, which other engines can repeat."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    A source is capped if its cap per weight is at most the level that remains when all with a lower
    cap per weight are capped; the others share what is left by weight. The windows run over one row per
    source, after partial sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("s"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("nth", nth).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    by_level = Window.orderBy(F.col("s") / F.col("w"), "nth")
    # all in units of 1 / SHARE[1], so that the comparisons are exact
    per = (
        per.withColumn("cap", F.col("s") * (CAP * SHARE[1]))
        .withColumn("pool", F.sum("s").over(everything) * SHARE[0])
        .withColumn("before", F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("weight_left", F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("capped", F.col("cap") * F.col("weight_left") <= (F.col("pool") - F.col("before")) * F.col("w"))
    )
    used = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    shared = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything)
    per = per.withColumn("used", used).withColumn("shared", shared)
    rest = (F.col("pool") - F.col("used")) * F.col("w") / (F.lit(SHARE[1]) * F.col("shared"))
    target = F.when(F.col("capped"), (F.col("s") * CAP).cast("double")).otherwise(rest)
    return per.select("source", F.col("s").alias("source_size"), target.cast("double").alias("target"))


def plan_mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc struct of the columns in ``keep``, size, source_size, target, copies)."""
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc")
    sized = docs.select(row, F.col("doc_id").alias("key"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"))
    plan = cut(targets(sized.select("source", "size"), weights))
    few = plan.count() <= BROADCAST_SOURCES
    plan = plan.withColumnRenamed("source", "of")
    joined = sized.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(draw(F.col("key"), seed) < rate - whole, 1).otherwise(0)
    return joined.select("doc", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``, each as often as it is taken."""
    planned = plan_mix(docs, None, weights, seed).where("copies > 0")
    return planned.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")

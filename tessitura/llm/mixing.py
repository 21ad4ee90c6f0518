"""Mixing sources to target weights by entropy balancing.

Targets: every source gets its weight's share of the wanted words, at most ``cap`` times what it has; what is cut off is
shared again by weight until none is above. Rates: of all rates that meet the targets, those closest to 1 in relative
entropy over the words are exponential tilts ``exp(lambda_source)``. Distributed Newton rounds on the convex dual
``sum(words * exp(lambda_source)) - sum(target * lambda)`` find the multipliers: documents of one source share a tilt, so
their words are first added up in cells (source and size octave), and each round sums gradient and curvature over all
cells; the residual ends them. Rounding: whole copies, largest documents first. Within a size class documents stand in
order of size and take ``floor(rate * (rank + 1) + phase) - floor(rate * rank + phase)`` copies, so a class misses its
words by no more than its largest document; the next smaller class is solved again for what is still missing, by a step
from the multipliers found.

Only SQL expressions are used; the text is read once and never shuffled. Per-source tables are as long as the list of
distinct sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import chosen, discard, identity, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Lower bounds of the size classes, in words. A class misses its target by one document at most.
CLASSES = (512, 64, 8, 0)
#: Where the first copy falls, as a part of a step; no multiple of a simple fraction, so that ties don't occur.
PHASE = 0.41421356237
#: Newton's rounds end when every source is met to this part of its target, or after so many.
RESIDUAL, NEWTON_STEPS = 1e-13, 60


def newton_step(words: DataFrame, lam: DataFrame) -> DataFrame:
    """One Newton round on the dual: source, target, lam (moved), mass (tilted words before the move) and missed.

    ``words`` (source, cell, words) sums the documents, ``lam`` has source, target and lam. Every cell is joined with its
    source's multiplier; its tilted words are the dual's curvature and, less the target, its gradient. The step is Newton's
    for the logarithm of tilted words over target, which has the same root and doesn't overshoot.
    """
    cells = words.select(F.col("source").alias("cell_source"), "words")
    tilted = cells.join(lam, cells["cell_source"].eqNullSafe(lam["source"]))
    mass = tilted.groupBy(F.col("source").alias("of")).agg(F.sum(F.col("words") * F.exp("lam")).alias("mass"))
    moved = lam.join(mass, lam["source"].eqNullSafe(mass["of"]), "left")
    full = (F.col("mass") > 0) & (F.col("target") > 0)
    step = F.when(full, -F.log(F.col("mass") / F.col("target"))).otherwise(0.0)
    missed = F.when(full, F.abs(F.col("mass") - F.col("target")) / F.col("target")).otherwise(0.0)
    return moved.select("source", "target", (F.col("lam") + step).alias("lam"), F.coalesce("mass", F.lit(0.0)).alias("mass"), missed.alias("missed"))


def newton(words: DataFrame, targets: DataFrame) -> DataFrame:
    """The dual's optimum from lam = 0 on: Newton rounds whose multipliers are written to the shared folder each time.

    They end when no source misses its target by more than RESIDUAL of it (the residual is one number for the driver), or
    after NEWTON_STEPS rounds.
    """
    lam = targets.select("source", F.col("target").cast("double").alias("target"), F.lit(0.0).alias("lam"))
    for k in range(NEWTON_STEPS):
        after = materialize(newton_step(words, lam.select("source", "target", "lam")), "dual")
        if k:
            discard(lam)
        lam = after
        if (lam.agg(F.max("missed")).first()[0] or 0.0) <= RESIDUAL:
            break
    return lam


def rates(solved: DataFrame, cap: float) -> DataFrame:
    """source and rate: min(cap, exp(lam)), 0 where there is nothing to take."""
    rate = F.when((F.col("mass") > 0) & (F.col("target") > 0), F.least(F.lit(float(cap)), F.exp("lam"))).otherwise(0.0)
    return solved.select("source", rate.alias("rate"))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target. Sources weigh ``weights`` in turn, by code point, null last."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    # A source is at its limit when its limit per weight is below the level; the level follows from running sums.
    per = per.withColumn("limit", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    everything = W.partitionBy(F.lit(0))
    rising = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(everything))
    per = per.withColumn("open", F.col("wanted") - F.coalesce(F.sum("limit").over(rising), F.lit(0.0)))
    per = per.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    per = per.withColumn("level", F.when(F.col("open") / F.col("rest") <= F.col("ratio"), F.col("open") / F.col("rest")))
    per = per.withColumn("level", F.max("level").over(everything))
    target = F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return per.select("source", "source_size", target.alias("target"))


def row_key(docs: DataFrame) -> Column:
    """What tells documents apart: doc_id, source and text."""
    return identity(docs["doc_id"], docs["source"], docs["text"])


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, *, lanes: int = 64, keyed: bool = False) -> DataFrame:
    """Copies and words that the mix takes of every document.

    ``docs`` needs doc_id, text and source; others are ignored. Returns doc_id, size (words), source, source_size,
    target (its source's), rate, copies (at most ``ceil(cap)``) and taken (copies * size); if ``keyed``, also row_key.

    Cases: null or empty text has size 0, takes 0 copies' words and keeps one copy; a null source is a source of its own,
    last in order; repeated rows are documents of their own, told apart by nothing but their order; a source without words
    has target 0; an empty table gives no rows.
    """
    rows = docs.select(docs["doc_id"], docs["text"], docs["source"], (row_key(docs) if keyed else F.lit("")).alias("row_key"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = rows.select("doc_id", "source", size.alias("size"), "row_key")
    sized = materialize(sized.withColumn("tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix")
    octave = F.length(F.bin("size"))
    cells = materialize(sized.where("size > 0").groupBy("source", octave.alias("cell")).agg(F.sum("size").alias("words"), F.max("size").alias("largest")), "mix-cells")
    targets = materialize(source_targets(sized, weights, share, cap), "mix-targets")
    bounds = [None, *CLASSES[:-1]]
    parts = [sized.where(F.col("size") == 0).select("doc_id", "size", "source", "row_key", F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))]
    dual = newton(cells, targets)
    taken = None
    for below, least in zip(bounds, CLASSES, strict=True):
        mine = sized.where((F.col("size") >= max(least, 1)) & (F.lit(True) if below is None else F.col("size") < below))
        solved = dual
        if taken is not None:
            # Classes begin at powers of two, so every cell lies in one of them. Sources share no documents, so that one
            # step from the dual's optimum solves what is left.
            done = taken.groupBy(F.col("source").alias("of")).agg(F.sum("got").alias("got"))
            left = dual.select("source", "target", "lam").join(done, F.col("source").eqNullSafe(F.col("of")), "left")
            left = left.select("source", (F.col("target") - F.coalesce("got", F.lit(0))).alias("target"), "lam")
            solved = newton_step(cells.where(F.col("largest") < below), left)
        plan = materialize(rates(solved, cap).withColumnRenamed("source", "s"), "mix-rates")
        part = materialize(_rounded(mine, plan, lanes), "mix-class")
        parts.append(part)
        got = part.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
        taken = got if taken is None else taken.unionByName(got)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = every.join(targets.withColumnRenamed("source", "s"), every["source"].eqNullSafe(F.col("s")))
    own = ["row_key"] if keyed else []
    return joined.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *own)


def _rounded(mine: DataFrame, plan: DataFrame, lanes: int) -> DataFrame:
    """Whole copies of one size class. Lanes of nearly equal sizes are numbered apart, so that no source meets in one task."""
    octave = F.length(F.bin("size")) - 1
    laned = mine.select("*", octave.alias("octave"), F.expr("shiftright(size, greatest(length(bin(size)) - 5, 0))").alias("mantissa"))
    laned = laned.withColumn("salt", F.pmod(F.conv(F.substring("tie", 1, 4), 16, 10).cast("int"), F.lit(lanes)))
    key = ["source", "octave", "mantissa", "salt"]
    before = W.partitionBy("source").orderBy(F.col("octave").desc(), F.col("mantissa").desc(), F.col("salt")).rowsBetween(W.unboundedPreceding, -1)
    starts = laned.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select(*[F.col(k).alias(f"{k}_") for k in key], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy(*key).orderBy(F.col("size").desc(), "tie", "row_key")
    ranked = laned.withColumn("rank", F.row_number().over(within) - 1)
    same = ranked["source"].eqNullSafe(starts["source_"])
    for k in key[1:]:
        same = same & (ranked[k] == starts[f"{k}_"])
    placed = ranked.join(starts, same).select("doc_id", "size", "source", "row_key", (F.col("start") + F.col("rank")).alias("at"))
    rated = placed.join(plan, placed["source"].eqNullSafe(plan["s"])).select("doc_id", "size", "source", "row_key", "rate", "at")
    copies = F.floor(F.col("rate") * (F.col("at") + 1) + PHASE) - F.floor(F.col("rate") * F.col("at") + PHASE)
    return rated.select("doc_id", "size", "source", "row_key", "rate", copies.cast("long").alias("copies"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns they came with.

    Of rows that share doc_id, source and text one stands for all and is repeated as often as all of them are taken.
    """
    plan = mix(docs, weights, share, cap, keyed=True).groupBy("row_key").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    return chosen(docs, [row_key(docs)], plan)

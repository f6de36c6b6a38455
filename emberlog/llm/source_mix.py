"""Mixing sources to target weights (6): weighted fair queueing over shuffled documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import fresh, own_columns, words
from emberlog.session import cut

#: Weights dealt to the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """From (source, source_size, n): (source, source_size, n, target).

    share times all words is dealt to the sources by weight; no target goes above epochs times its source, and what a
    source can't take is dealt to the others again by weight until none is above. That fixed point is reached at once:
    with sources in the order of cap / weight, those before the first one whose cap is not met are at their caps.
    One row for each source is all that a single task sees.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("rate", (F.lit(share) * F.sum("source_size").over(everything) - F.col("before")) / F.col("open"))
    t = t.withColumn("rate", F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("k"), F.col("rate").alias("rate")))).over(everything)["rate"])
    target = F.when(F.col("rate").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("rate") * F.col("weight")))
    return t.select("source", "source_size", "n", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, epochs: int = 2, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """Decide how often the mix takes each document.

    Every source's documents are shuffled by the MD5 of seed and id and offered `epochs` times over. A document's
    virtual finish time is its source's words up to and including it, divided by the source's target; all offers are
    ranked by it (half of the last one counts, so that a source ends within half a document of its target) and taken
    until the total budget is spent. Running sums over a source and over the whole rank are made in two levels, each of
    about the square root of the rows, so that no source and no rank lies in one task.

    Sizes are numbers of runs without ASCII white space; null and empty texts have 0, and are never taken. Null sources
    form the last source. Ties (repeated ids) are broken by size; equal repeated rows share one decision each. Returns
    (doc_id, source, size, source_size, target, taken, copies), a row for each input row; an empty table gives none.
    """
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col).cast("string"))).cast("long").alias("size"), shuffled.alias("draw"), F.monotonically_increasing_id().alias("row_id")), "sizes")
    sources = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), share, epochs, weights), "targets")

    # running words of each source in shuffled order; a slice holds about as many rows as the source has slices
    known = rows.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, rows.source.eqNullSafe(sources.source)).select(rows["*"], "source_size", "target", "n")
    part = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    known = known.withColumn("slice", F.floor(part * F.ceil(F.sqrt("n"))))
    slices = known.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    starts = slices.withColumn("start", F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words")).select(F.col("source").alias("s"), F.col("slice").alias("k"), "start")
    within = Window.partitionBy("source", "slice").orderBy("draw", "size", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = known.withColumn("upto", F.sum("size").over(within))
    known = known.join(starts, known.source.eqNullSafe(starts.s) & (known.slice == starts.k)).withColumn("upto", F.col("start") + F.col("upto")).drop("s", "k", "start", "slice")
    known = cut(known, "queue")

    offers = known.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    finish = (F.lit(2) * (F.col("upto") + F.col("epoch") * F.col("source_size")) - F.col("size")) / (F.lit(2.0) * F.col("target"))
    offers = offers.withColumn("finish", finish)
    total = sources.agg(F.sum("target").alias("t"), F.sum("n").alias("n")).first()
    budget, n = total["t"] or 0.0, total["n"] or 0
    steps = max(1, int(n**0.5))
    # the global rank: the step in which the budget ends is found from sums, and only its offers are ranked one by one
    offers = offers.withColumn("step", F.least(F.floor(F.col("finish") * steps), F.lit(steps * (epochs + 1) * 4)))
    sums = offers.groupBy("step").agg(F.sum("size").alias("words"))
    rank = sums.withColumn("start", F.sum("words").over(Window.orderBy("step")) - F.col("words"))
    edge = rank.where(F.col("start") < budget).orderBy(F.desc("step")).first()
    last, start = (edge["step"], edge["start"]) if edge else (-1, 0)
    fine = Window.orderBy("finish", F.col("source").asc_nulls_last(), "draw", "size", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = offers.where(F.col("step") == last).withColumn("after", F.sum("size").over(fine) + start).where(F.col("after") - F.col("size") / 2 <= budget)
    taken = offers.where(F.col("step") < last).select("row_id").union(some.select("row_id")).groupBy("row_id").agg(F.count("*").alias("copies"))
    out = known.join(taken, "row_id", "left").withColumn("copies", F.coalesce("copies", F.lit(0).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; rows that share an id are all taken as often as the one taken most."""
    id_col = options.get("id_col", "doc_id")
    mix_id, copies, nth = (fresh(docs, x) for x in ("_mix_id", "_copies", "_nth"))
    counts = mix(docs, **options).where("copies > 0").groupBy(F.col("doc_id").alias(mix_id)).agg(F.max("copies").alias(copies))
    found = docs.join(counts, F.col(id_col).cast("long").eqNullSafe(F.col(mix_id)))
    return found.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*own_columns(docs))

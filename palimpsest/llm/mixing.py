"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, global_rank, stash, word_count

#: Sources of which the plan may be broadcast: about 100 bytes a row, 10 MB in all.
BROADCAST_SOURCES = 100_000


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to rows (source_size, weight).

    The budget is ``share`` times all sizes. A source is clamped at
    ``max_epochs`` times its size; what it can't take is shared again among
    the others by weight, until none is above its clamp. Each turn is one
    aggregate of one row; the level only rises, so the clamped set is given
    by the level alone.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    budget = share * float(total["s"] or 0)
    rest, weight, clamped = budget, float(total["w"] or 0), 0
    while weight > 0:
        full = cap <= F.col("weight") * F.lit(rest) / F.lit(weight)
        row = sources.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, cap)).alias("cap"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if row["n"] == clamped:
            break
        clamped, rest, weight = row["n"], budget - float(row["cap"]), float(row["weight"] or 0)
    level = F.col("weight") * F.lit(rest) / F.lit(weight) if weight > 0 else cap
    return sources.withColumn("target", F.least(cap, level))


def mix(
    documents: DataFrame,
    *,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    size: Column | None = None,
) -> DataFrame:
    """Choose how often each row of ``documents`` (doc_id, text, source) enters the mix.

    Sources in code-point order, null last, take ``weights`` in turn. Each
    gets a target by ``water_fill``. A row is repeated wholly
    ``floor(target / source_size)`` times; the rest of the target goes to
    rows in the order of a seeded hash of doc_id, each whole, up to the row
    whose middle passes it. So a source misses its target by half a row at
    most, and no row is taken more than ``max_epochs`` times (rounded up).

    Returns doc_id, size, source, source_size, target, repeats, taken.
    Null text: size 0. Null source: a source of its own. Null doc_id: hashed
    as empty. Repeated rows: each is a row of its own. Empty table: empty.
    A source without words has target 0. Other columns are ignored.
    """
    text = F.col("text")
    sized = stash(
        documents.select(
            "doc_id",
            "source",
            (word_count(text) if size is None else size).alias("size"),
            F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary")).alias("h"),
        ).withColumn("bucket", F.substring("h", 1, 4)),
        "mix-sizes",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sums, F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = stash(ranked.withColumn("weight", turn), "mix-sources")
    filled = water_fill(sources, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))

    # The hash bucket in which the rest of a source's target runs out.
    order = Window.partitionBy("source").orderBy("bucket")
    buckets = (
        sized.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    )
    filled = filled.withColumnRenamed("source", "plan_source")
    ends = (
        buckets.join(filled.select("plan_source", "part"), F.col("source").eqNullSafe(F.col("plan_source")))
        .where((F.col("part") > 0) & (F.col("before") + F.col("words") > F.col("part")))
        .groupBy(F.col("source").alias("end_source"))
        .agg(F.min(F.struct("bucket", "before")).alias("end"))
    )
    plan = filled.join(ends, F.col("plan_source").eqNullSafe(F.col("end_source")), "left")
    plan = stash(plan.select("plan_source", "source_size", "target", "whole", "part", "end"), "mix-plan")
    plan = broadcast_if_small(plan, plan.count(), BROADCAST_SOURCES)
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left")

    keep = ("doc_id", "size", "source", "source_size", "target", "whole")
    at_end = F.coalesce(F.col("bucket") == F.col("end.bucket"), F.lit(False))
    far = rows.where(~at_end).select(*keep, F.coalesce(F.col("bucket") < F.col("end.bucket"), F.lit(False)).cast("long").alias("extra"))
    within = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    until = F.col("end.before") * 2 + F.sum("size").over(within) * 2 - F.col("size")
    near = rows.where(at_end).select(*keep, (until <= F.col("part") * 2).cast("long").alias("extra"))
    repeats = F.col("whole") + F.col("extra")
    return far.unionByName(near).select(
        "doc_id", "size", "source", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken")
    )


def repeat_rows(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``documents`` as often as ``mix`` says, with its own columns.

    Rows are matched by doc_id and size; rows that share both take the mean
    share of their group, handed out in the order of a hash of the whole row.
    """
    times = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_words")).agg(
        F.min("repeats").alias("_least"), F.sum("repeats").alias("_all"), F.count("*").alias("_rows")
    )
    # the row's own columns travel in one struct, whatever their names
    left = documents.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), word_count(F.col("text")).alias("_size"))
    joined = left.join(times, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_size") == F.col("_words")))
    single = joined.where("_rows = 1").withColumn("_n", F.col("_all"))
    nth = F.row_number().over(Window.partitionBy("_doc", "_size").orderBy(F.xxhash64("_row")))
    shared = joined.where("_rows > 1").withColumn("_n", F.col("_least") + (nth <= F.col("_all") - F.col("_least") * F.col("_rows")).cast("long"))
    return single.unionByName(shared).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")

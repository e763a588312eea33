"""Evaluation: coverage, tallies, F1, latency and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coverage(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Share of each gold span (doc_id, start, end) under the union of predictions; empty ones count as covered."""
    p = predicted.select(F.col("doc_id").alias("_id"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    rows = gold.join(p, (F.col("doc_id") == F.col("_id")) & (F.col("ps") < F.col("end")) & (F.col("pe") > F.col("start")), "left")
    parts = F.sort_array(F.collect_list(F.when(F.col("ps").isNotNull(), F.struct(F.greatest("ps", "start").alias("s"), F.least("pe", "end").alias("e")))))
    rows = rows.groupBy("doc_id", "start", "end").agg(parts.alias("parts"))
    total = F.aggregate(
        "parts",
        F.struct(F.col("start").alias("at"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["at"], x["e"]).alias("at"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["at"], x["s"]))).alias("n")),
    )["n"]
    return rows.select("doc_id", "start", "end", F.when(F.col("end") > F.col("start"), total / (F.col("end") - F.col("start"))).otherwise(F.lit(1.0)).alias("coverage"))


def tally(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    """Hits, totals and ratios of each category and, with category null, of all."""
    out = rows.rollup(F.col(by).alias("category")).agg(F.sum(hit.cast("long")).alias("hits"), F.count("*").alias("total"))
    return out.withColumn("ratio", F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def latency(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Rounded mean and nearest-rank 95th percentile."""
    return rows.groupBy(*by).agg(F.round(F.avg(value)).alias("mean"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def first_samples(rows: DataFrame, by: str, order: str, n: int = 5) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= n).drop("_n")

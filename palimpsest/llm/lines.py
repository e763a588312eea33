"""Line deduplication by content-defined chunks of lines (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Modulus and multiplier of the rolling hash over 48-bit line hashes.
MODULUS, FACTOR = 281_474_976_710_597, 31


def _chunked(documents: DataFrame) -> DataFrame:
    """doc_id, lines and chunks (s, e): runs of lines that start where the rolling hash has a local minimum.

    The rolling hash of a line covers it and the two lines before. Whether a
    line starts a chunk depends on the hashes next to it alone, so lines
    added elsewhere don't move boundaries, and every chunk but the last has
    two lines or more.
    """
    one = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 12), 16, 10).cast("long")
    at = lambda a, i: F.coalesce(F.get(F.col(a), i), F.lit(0))
    rolled = lambda x, i: F.pmod(x + at("hs", i - 1) * FACTOR + at("hs", i - 2) * (FACTOR * FACTOR), F.lit(MODULUS))
    low = lambda i: F.coalesce((F.get("rs", i) < F.get("rs", i - 1)) & (F.get("rs", i) < F.get("rs", i + 1)), F.lit(False))
    n = F.size("lines")
    return (
        documents.where("text is not null")
        .select("doc_id", F.split("text", "\n", -1).alias("lines"))
        .withColumn("hs", F.transform("lines", one))
        .withColumn("rs", F.transform("hs", rolled))
        .withColumn("starts", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | low(i)))
        .select("doc_id", "lines", F.transform("starts", lambda s, k: F.struct(s.alias("s"), F.coalesce(F.get("starts", k + 1), n).alias("e"))).alias("chunks"))
    )


def _text(s: Column, e: Column) -> Column:
    return F.array_join(F.slice(F.col("lines"), s + 1, e - s), "\n")


def line_dedup(documents: DataFrame, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every repeat of a multi-line chunk (two non-blank lines or more) but its first occurrence.

    First is the smallest (doc_id, line). Chunks meet by md5; before a chunk
    goes, its bytes are compared with those of the first occurrence. Lines
    are split at \\n only. Rows that share a doc_id share one place in the
    order: a chunk first seen there stays in all of them.

    Returns doc_id, text (what is left), n_lines, n_removed, and the columns
    named in ``carry``. Null text stays
    null with 0 lines; empty text is one line. Empty table: empty. Other
    columns are ignored.
    """
    spread = _chunked(documents).select(
        "doc_id",
        F.explode(
            F.expr(
                "transform(filter(chunks, c -> c.e - c.s > 1), c -> struct(c.s as s, c.e as e, "
                "md5(cast(array_join(slice(lines, c.s + 1, c.e - c.s), '\\n') as binary)) as h, "
                f"size(filter(slice(lines, c.s + 1, c.e - c.s), x -> x rlike r'{WORD}')) > 1 as full))"
            )
        ).alias("c"),
    )
    spread = spread.where("c.full").select("doc_id", "c.s", "c.e", "c.h")
    first = F.min(F.struct("doc_id", "s", "e")).alias("first")
    repeated = spread.groupBy("h").agg(first, F.count("*").alias("n")).where("n > 1").select("h", F.col("first.doc_id").alias("doc_id"), F.col("first.s").alias("s"), F.col("first.e").alias("e"))

    # The bytes of each first occurrence, then the places that repeat them. Both meet the texts in one shuffle by doc_id.
    texts = documents.select("doc_id", "text", *carry)
    firsts = repeated.groupBy(F.col("doc_id").alias("mark_id")).agg(F.collect_set(F.struct("s", "e", "h")).alias("marks"))
    canon = (
        texts.join(firsts, F.col("doc_id").eqNullSafe(F.col("mark_id")))
        .where("text is not null")
        .select("doc_id", F.split("text", "\n", -1).alias("lines"), F.explode("marks").alias("m"))
        .select(F.col("doc_id").alias("first_id"), F.col("m.s").alias("first_s"), F.col("m.h").alias("h"), _text(F.col("m.s"), F.col("m.e")).alias("bytes"))
        .dropDuplicates(["h", "bytes"])
    )
    again = spread.join(canon, "h").where(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("s") == F.col("first_s"))))
    marks = again.groupBy("doc_id").agg(F.collect_set(F.struct("s", "e", "bytes")).alias("marks"))
    marks = marks.withColumnRenamed("doc_id", "mark_id")

    same = lambda m: F.coalesce(_text(m["s"], m["e"]) == m["bytes"], F.lit(False))
    before = lambda k: F.when(k > 0, F.get("edges", k - 1)["e"]).otherwise(0)
    cut = (
        documents.select("doc_id", "text", *carry)
        .join(marks, F.col("doc_id").eqNullSafe(F.col("mark_id")), "left")
        .select("doc_id", "text", F.split("text", "\n", -1).alias("lines"), "marks", *carry)
        .withColumn("gone", F.array_sort(F.transform(F.filter("marks", same), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e")))))
        .withColumn("edges", F.concat("gone", F.array(F.struct(F.size("lines").alias("s"), F.size("lines").alias("e")))))
        .withColumn("left", F.flatten(F.transform("edges", lambda g, k: F.slice("lines", before(k) + 1, g["s"] - before(k)))))
    )
    touched = F.coalesce(F.size("gone") > 0, F.lit(False))
    return cut.select(
        "doc_id",
        F.when(touched, F.array_join("left", "\n")).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.array_size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(touched, F.size("lines") - F.size("left")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        *carry,
    )

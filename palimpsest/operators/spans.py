"""Span algebra: trimming, filters, overlaps, gaps and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import SHORT_WORDS

# Characters trimmed from the ends of model spans; short tokens that are no persons.
LEAD = r"^[\s,;:.!?()\[\]{}\"'`*_\-–—/\\|<>«»„“”‘’]+"
TRAIL = r"[\s,;:!?()\[\]{}\"'`*_\-–—/\\|<>«»„“”‘’]+$"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]"
FIELDS = ("type", "value", "start", "end", "confidence", "detector", "ordinal")


def trim_punctuation(spans: DataFrame) -> DataFrame:
    """Strip edge punctuation and shift the offsets; spans of punctuation alone go."""
    core = F.regexp_replace(F.regexp_replace("value", LEAD, ""), TRAIL, "")
    lead = F.length(F.regexp_extract("value", LEAD, 0))
    start = (F.col("start") + lead).cast("int")
    return spans.withColumns({"value": core, "start": start, "end": (start + F.length(core)).cast("int")}).where(F.length("value") > 0)


def drop_short(spans: DataFrame) -> DataFrame:
    """Keep values of three characters, persons and unspaced scripts of two; titles and particles alone are no persons."""
    n = F.length(F.trim("value"))
    unspaced = F.col("value").rlike(UNSPACED)
    least = F.when(unspaced | (F.col("type") == "PERSON"), 2).otherwise(3)
    title = (F.col("type") == "PERSON") & ~unspaced & F.lower(F.trim("value")).isin(*SHORT_WORDS)
    return spans.where((n >= least) & ~title)


def at_threshold(spans: DataFrame, threshold: float) -> DataFrame:
    return spans.where(F.col("confidence") >= min(0.95, max(0.05, threshold)))


def _gathered(spans: DataFrame, order) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS)), order).alias("spans"))


def _by(*keys: tuple[str, bool]):
    """Comparator over span structs: (field, descending)."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for field, down in reversed(keys):
            less, more = (1, -1) if down else (-1, 1)
            x, y = (a["end"] - a["start"], b["end"] - b["start"]) if field == "length" else (a[field], b[field])
            out = F.when(x < y, less).when(x > y, more).otherwise(out)
        return out

    return compare


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """Non-overlapping spans of each document: by start, then longer, then surer, then rule order; first come stays.

    Sorted by start, a span overlaps a kept one exactly if it starts before
    the largest end kept, so one fold with one number decides. A document's
    spans, not its text, meet in one row.
    """
    order = _by(("start", False), ("length", True), ("confidence", True), ("ordinal", False))
    rows = _gathered(spans, order)
    kept = F.aggregate(
        "spans",
        F.struct(F.lit(-1).alias("e"), F.slice("spans", 1, 0).alias("k")),
        lambda a, s: F.when(s["start"] >= a["e"], F.struct(s["end"].alias("e"), F.concat(a["k"], F.array(s)).alias("k"))).otherwise(a),
    )["k"]
    return rows.select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.*")


def clipped(spans: DataFrame) -> DataFrame:
    """What the spans before it leave of each span, with that part as its value; covered ones go. Rows that share a doc_id count as one text."""
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    at = F.greatest("start", F.coalesce(F.max("end").over(order), F.lit(0)))
    rows = spans.withColumn("_at", at).where(F.col("_at") < F.col("end"))
    return rows.withColumns({"value": F.substr("value", F.col("_at") - F.col("start") + 1), "start": F.col("_at").cast("int")}).drop("_at")


def greedy_select(spans: DataFrame) -> DataFrame:
    """Best-first selection: by confidence, a span stays if it is disjoint from all that stay before it."""
    rows = _gathered(spans, _by(("confidence", True), ("start", False), ("end", False), ("ordinal", False)))
    kept = F.aggregate(
        "spans",
        F.slice("spans", 1, 0),
        lambda k, s: F.when(F.exists(k, lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"])), k).otherwise(F.concat(k, F.array(s))),
    )
    return rows.select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.*")


def catch_all_gaps(spans: DataFrame, unsure: float = 0.5, sure: float = 0.8) -> DataFrame:
    """What sure spans (confidence >= ``sure``) leave of each unsure one (<= ``unsure``): doc_id, detector, start, end of every gap."""
    wide = spans.where(F.col("confidence") <= unsure).select("doc_id", "detector", "start", "end")
    cover = spans.where(F.col("confidence") >= sure).groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cover"))
    rows = wide.join(cover, F.col("doc_id") == F.col("_id"), "left")
    inside = F.filter(F.coalesce("cover", F.array().cast("array<struct<start:int,end:int>>")), lambda c: (c["start"] < F.col("end")) & (c["end"] > F.col("start")))
    rows = rows.withColumn("inside", inside)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    gaps = F.aggregate(
        F.concat("inside", F.array(F.struct(F.col("end").alias("start"), F.col("end").alias("end")))),
        F.struct(F.col("start").alias("at"), empty.alias("gaps")),
        lambda a, c: F.struct(
            F.greatest(a["at"], c["end"]).alias("at"),
            F.when(c["start"] > a["at"], F.concat(a["gaps"], F.array(F.struct(a["at"].alias("start"), c["start"].alias("end"))))).otherwise(a["gaps"]).alias("gaps"),
        ),
    )["gaps"]
    return rows.select("doc_id", "detector", F.explode(gaps).alias("g")).select("doc_id", "detector", "g.start", "g.end")


def overlapping(left: DataFrame, right: DataFrame, anti: bool = False) -> DataFrame:
    """Rows of ``left`` (doc_id, start, end) that overlap a row of ``right`` of the same document; anti: that overlap none."""
    other = right.select(F.col("doc_id").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    meets = (F.col("doc_id") == F.col("_id")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))
    return left.join(other, meets, "left_anti" if anti else "left_semi")


def valid_spans(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans whose offsets still give their value."""
    texts = documents.select(F.col("doc_id").alias("_id"), "text")
    rows = spans.join(texts, F.col("doc_id") == F.col("_id"))
    fits = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    return rows.where(fits & (F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("value"))).select(*spans.columns)

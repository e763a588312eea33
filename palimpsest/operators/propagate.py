"""Propagation: what was found once is found again elsewhere in the same document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import LEGAL_FORMS
from .spans import UNSPACED

WORD_CHAR = r"[\p{L}\p{N}_]"


def terms(spans: DataFrame) -> DataFrame:
    """What to look for, one row for each distinct term in lower case: doc_id, term, type, exact.

    Every value of two characters or more; a company without its legal form;
    the words of persons of four characters or more; and words with a digit
    of five or more, in exact case. First come by start decides the type.
    """
    value = F.trim("value")
    base = spans.select("doc_id", "start", "type", value.alias("value"))
    own = base.where(F.length("value") >= 2).select("doc_id", "start", F.lit(0).alias("rank"), F.col("value").alias("term"), "type", (F.length("value") <= 2).alias("exact"))
    name = F.regexp_replace("value", r",?\s+\S+$", "")
    form = F.lower(F.regexp_replace(F.substr("value", F.length(name) + 1), r"[\s,.]", ""))
    firm = base.where((F.col("type") == "COMPANY") & form.isin(*LEGAL_FORMS) & name.rlike(r"\s")).select("doc_id", "start", F.lit(1).alias("rank"), name.alias("term"), "type", F.lit(False).alias("exact"))
    words = base.where(F.col("value").contains(" ")).select("doc_id", "start", "type", F.explode(F.split("value", r"\s+")).alias("w"))
    words = words.withColumn("w", F.regexp_replace("w", r"[.,;:!?()]+$", "")).where(F.length("w") >= 4)
    number = F.col("w").rlike("[0-9]") & (F.length("w") >= 5)
    words = words.where((F.col("type") == "PERSON") | number).select("doc_id", "start", F.lit(2).alias("rank"), F.col("w").alias("term"), "type", (F.col("type") != "PERSON").alias("exact"))
    rows = own.unionByName(firm).unionByName(words).groupBy("doc_id", F.lower("term").alias("folded")).agg(F.min(F.struct("start", "rank", "term", "type", "exact")).alias("t"))
    return rows.select("doc_id", "t.term", "t.type", "t.exact")


def propagate(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Further places of found values: doc_id, type, value, start, end, confidence, detector.

    A term counts between characters that are no word characters, unless its
    own end is in an unspaced script; case is free unless the term is exact.
    Places that a span has already are left out. Of occurrences that overlap
    each other, the first counts. A document meets its own terms only; null
    doc_ids meet theirs.
    """
    found = terms(spans)
    rows = documents.select("doc_id", "text").join(found.select(F.col("doc_id").alias("_id"), "term", "type", "exact"), F.col("doc_id").eqNullSafe(F.col("_id")))
    pattern = F.concat(F.when(F.col("exact"), "").otherwise("(?iu)"), F.lit("\\Q"), F.replace("term", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    rows = rows.withColumn("_p", pattern)
    hits = F.expr(
        "aggregate(split(text, _p, -1), struct(0 as at, cast(array() as array<int>) as v), "
        "(a, x) -> struct(a.at + length(x) + length(term) as at, concat(a.v, array(a.at + length(x))) as v)).v"
    )
    n = F.length("term")
    at = rows.select("doc_id", "text", "term", "type", F.explode(hits).alias("start")).where(F.col("start") + n <= F.length("text"))
    before, after = F.substr("text", F.col("start"), F.lit(1)), F.substr("text", F.col("start") + n + 1, F.lit(1))
    open_left = F.substring("term", 1, 1).rlike(UNSPACED) | (F.col("start") == 0) | ~before.rlike(WORD_CHAR)
    open_right = F.substr("term", n, F.lit(1)).rlike(UNSPACED) | ~F.coalesce(after, F.lit("")).rlike(WORD_CHAR)
    new = at.where(open_left & open_right).select("doc_id", "type", F.substr("text", F.col("start") + 1, n).alias("value"), F.col("start").cast("int").alias("start"), (F.col("start") + n).cast("int").alias("end")).distinct()
    known = spans.select(F.col("doc_id").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    new = new.join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left_anti")
    return new.select("*", F.lit(0.95).alias("confidence"), F.lit("propagated").alias("detector"))

"""Lines and the rule scan: text to typed spans with offsets, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import is_name_rule, name_rule, name_run
from ..functions.validators import validator
from ..plans.rules import ANY_SPACE, RULES, SPACES, Rule, any_of, is_class, java_pattern, without_head


def segment_lines(documents: DataFrame) -> DataFrame:
    """Non-empty lines of (doc_id, text): doc_id, line_no (from 0), line, line_start in code points. Only \\n ends a line."""
    lines = F.split("text", "\n", -1)
    rows = documents.select("doc_id", F.posexplode(F.arrays_zip(lines.alias("line"), _ends(F.transform(lines, lambda x: F.length(x) + 1)).alias("end"))).alias("line_no", "l"))
    return rows.where(F.length("l.line") > 0).select("doc_id", "line_no", F.col("l.line").alias("line"), (F.col("l.end") - F.length("l.line") - 1).alias("line_start"))


def _ends(sizes: Column) -> Column:
    """Running sums of an array in one pass."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("v"))
    return F.aggregate(sizes, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["v"], F.array(a["at"] + x)).alias("v")))["v"]


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches_sql(column: str, pattern: str, ordinal: int = 0) -> str:
    """SQL for an array of (ordinal, value, start) of all leftmost matches: the pieces between them give the offsets, in one pass."""
    p, hit = _literal(pattern), "struct<ordinal:int,value:string,start:int>"
    return (
        f"aggregate(zip_with(split({column}, {p}, -1), regexp_extract_all({column}, {p}, 0), (p, v) -> struct(p, v)), "
        f"struct(0 as at, cast(array() as array<{hit}>) as hits), (a, x) -> struct(a.at + length(x.p) + coalesce(length(x.v), 0) as at, "
        f"if(x.v is null or x.v = '', a.hits, concat(a.hits, array(struct({ordinal} as ordinal, x.v as value, a.at + length(x.p) as start)))) as hits)).hits"
    )


def matches(column: str, pattern: str) -> Column:
    """Array of (ordinal, value, start) of all leftmost matches in a column; zero-width ones are skipped."""
    return F.expr(_matches_sql(column, pattern))


def _flat(column: str) -> str:
    """SQL for a text with plain spaces for SPACES; most texts have none of them and stay as they are."""
    return f"if({column} rlike {_literal(ANY_SPACE)}, translate({column}, '{SPACES}', '{' ' * len(SPACES)}'), {column})"


def _need(rule: Rule) -> str:
    return rule.need or java_pattern(rule.pattern, rule.flags, flat=True)


def _held_lines(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The lines that hold what one of the rules needs: doc_id, line, line_start. Few do, so the rules are tried on these only."""
    needs = list(any_of(dict.fromkeys(map(_need, rules))))
    held = " or ".join(f"y rlike {_literal(p)}" for p in needs)
    kept = (
        f"aggregate(split(text, '\\n', -1), struct(0 as at, cast(array() as array<struct<line:string,line_start:int>>) as k), (a, x) -> struct(a.at + length(x) + 1 as at, "
        f"if(exists(array({_flat('x')}), y -> {held}), concat(a.k, array(struct(x as line, a.at as line_start))), a.k) as k)).k"
    )
    # single characters can be looked for in the whole text first
    texts = documents.where(F.col("text").rlike(needs[0])) if len(needs) == 1 and is_class(needs[0]) else documents
    return texts.select("doc_id", F.explode_outer(F.expr(kept)).alias("l")).where("l is not null").select("doc_id", "l.line", "l.line_start")


def _candidates(texts: DataFrame, column: str, rules: list[tuple[int, Rule]]) -> DataFrame:
    """One row for each match of a rule: the other columns with ordinal, value, start. A rule whose cheap test fails is not tried.

    The rules are one SQL text, so that building the plan takes little time, and the pattern of each is a literal, compiled
    once. Rules with the same cheap test share it, and cheap tests share a test of all.
    """
    none = "cast(array() as array<struct<ordinal:int,value:string,start:int>>)"
    found = lambda tests, hits: f"if({' and '.join(f'_flat rlike {_literal(p)}' for p in tests)}, {hits}, {none})"
    every = lambda hits: f"concat({', '.join(hits)})"
    tried: dict[str, list[str]] = {}
    for i, r in rules:
        pattern = java_pattern(r.pattern, r.flags, flat=True)
        tests = [p for p in (without_head(r.pattern, r.flags), pattern) if p]
        tried.setdefault(_need(r), []).append(found(tests, _matches_sql("_flat", pattern, i)))
    each = [found([p], every([found([need], every(tried[need])) for need in needs])) for p, needs in any_of(tried).items()]
    # outer: an inner explode makes the planner test the whole array once more before it
    flat = texts.withColumn("_flat", F.expr(_flat(column)))
    rows = flat.withColumn("_hit", F.explode_outer(F.expr(every(each)))).where("_hit is not null")
    value = F.substr(F.col(column), F.col("_hit.start") + 1, F.length("_hit.value"))
    return rows.select(*[c for c in texts.columns if c != column], "_hit.ordinal", value.alias("value"), "_hit.start")


def scan(documents: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Candidate spans of (doc_id, text): one pass over the lines that a rule needs, and over whole texts for multi-line rules.

    Columns doc_id, type, value, start, end, confidence, detector, ordinal.
    Both ends are trimmed, a rule's check decides last, and names are cut to
    their run of capitalised words. Null texts have no spans. No shuffle.
    """
    rules = list(enumerate(rules))
    found = []
    by_line = [(i, r) for i, r in rules if not r.multiline]
    if by_line:
        hits = _candidates(_held_lines(documents, [r for _, r in by_line]), "line", by_line)
        found.append(hits.select("doc_id", "ordinal", "value", (F.col("start") + F.col("line_start")).alias("start")))
    whole = [(i, r) for i, r in rules if r.multiline]
    if whole:
        found.append(_candidates(documents.where("text is not null").select("doc_id", "text"), "text", whole).select("doc_id", "ordinal", "value", "start"))
    return checked(reduce(DataFrame.unionByName, found), rules)


def checked(hits: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Hits (doc_id, ordinal, value, start, ...) as spans: trimmed, checked, cut to names, with what their rules say."""
    of = lambda f: "element_at(array(" + ", ".join(f(r) for _, r in rules) + "), _place)"
    place = "element_at(map(" + ", ".join(f"{i}, {k + 1}" for k, (i, _) in enumerate(rules)) + "), ordinal)" if [i for i, _ in rules] != list(range(len(rules))) else "ordinal + 1"
    other = [c for c in hits.columns if c not in ("ordinal", "value", "start")]

    def fixed(df: DataFrame, **columns: Column) -> DataFrame:
        """Columns as the output of an explode: the planner would write their expressions out wherever they are used."""
        kept = [c for c in df.columns if c not in columns and c != "_fixed"]
        return df.select(*kept, F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_fixed")).select(*kept, "_fixed.*")

    lead = F.length(F.regexp_extract("value", r"^\s*", 0))
    check = F.expr(of(lambda r: _literal(r.validate or "")))
    detector = F.expr(of(lambda r: _literal(r.detector)))
    rows = fixed(hits.withColumn("_place", F.expr(place)), start=F.col("start") + lead, value=F.regexp_replace("value", r"^\s+|\s+$", ""), _check=check, detector=detector).where("value <> ''")
    names = sorted({r.validate for _, r in rules if r.validate})
    if names:
        good = F.when(F.col("_check") == "", True)
        for name in names:
            good = good.when(F.col("_check") == name, validator(name)(F.col("value")))
        rows = rows.where(F.coalesce(good, F.lit(False)))
    if any(is_name_rule(r.detector) for _, r in rules):
        run = F.when(name_rule(F.col("detector")), name_run(F.col("detector"), F.col("value"))).otherwise(F.struct(F.lit(0).alias("skip"), F.col("value").alias("value")))
        rows = fixed(rows, _run=run).where("_run is not null")
        rows = fixed(rows, start=F.col("start") + F.col("_run.skip"), value=F.col("_run.value"))
    return rows.select(
        *other,
        F.expr(of(lambda r: _literal(r.type))).alias("type"),
        "value",
        F.col("start").cast("int").alias("start"),
        (F.col("start") + F.length("value")).cast("int").alias("end"),
        F.expr(of(lambda r: f"cast({r.confidence} as double)")).alias("confidence"),
        "detector",
        F.col("ordinal").cast("int").alias("ordinal"),
    )


def number_spans(spans: DataFrame) -> DataFrame:
    """Add ``n``: the order of a document's spans by start, then rule."""
    return spans.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "ordinal")))

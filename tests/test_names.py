"""Null and shared ids, restoring, names and propagation on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import names
from palimpsest.operators import propagate, scan, session, spans
from palimpsest.plans.rules import RULES

SPAN = "doc_id long, type string, value string, start int, end int, confidence double, detector string, ordinal int"


def test_redaction_with_null_and_shared_ids(spark):
    rows = [(None, "mail a@b.com now", "x"), (5, "one long text then c@d.com end", "x"), (5, "to e@f.com", "x"), (6, "none", "x"), (7, None, "x"), (7, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m string")
    found = scan.scan(docs, RULES[:1])
    out = sorted((r.text or "") for r in session.redact(docs, found).collect())
    assert out == sorted(re.sub(r"\S+@\S+", "________", t or "") for _, t, _ in rows)
    mapping = session.number_placeholders(found)
    hidden = session.redact(docs, found, mapping)
    assert not hidden.where("text like '%@%'").count()
    back = session.restore(hidden.withColumn("m", F.lit(1)), mapping)
    assert sorted((r.doc_id or 0, r.text or "") for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)


def test_tolerant_restoring(spark):
    mapping = spark.createDataFrame([(1, "PERSON", "Jan Nowak", "[PERSON_1]", 1), (1, "EMAIL", "j@n.pl", "[EMAIL_1]", 2)], "doc_id long, entity_type string, original string, replacement string, seq int")
    replies = {"Dear [PERSON_1]": "Dear Jan Nowak", "[person 1] wrote": "Jan Nowak wrote", "**[PERSON-1]**": "Jan Nowak", "by PERSON_1, EMAIL_1": "by Jan Nowak, j@n.pl", "person 1 and SOME_PERSON_1 and [PERSON_9]": "person 1 and SOME_PERSON_1 and [PERSON_9]"}
    docs = spark.createDataFrame([(1, t) for t in replies], "doc_id long, text string")
    assert sorted(r.text for r in session.restore(docs, mapping, tolerant=True).collect()) == sorted(replies.values())


@pytest.mark.parametrize(
    "detector, value, kept",
    [
        ("regex:fr:company", "pour le compte de la Soci\u00e9t\u00e9 Martin SARL", "Soci\u00e9t\u00e9 Martin SARL"),
        ("regex:de:company", "die Firma M\u00fcller und Sohn GmbH", "Firma M\u00fcller und Sohn GmbH"),
        ("regex:no:company", "The ACAS", None),
        ("regex:fr:company", "de la SCI", None),
        ("regex:de:street", "Herr Klaus M\u00fcller wohnt in der K\u00f6nigstra\u00dfe 45", "K\u00f6nigstra\u00dfe 45"),
        ("regex:es:street", "c inter\u00e9s al tipo 5", None),
        ("regex:de:postal", "60311 Frankfurt am Main liegt", "60311 Frankfurt am Main"),
        ("regex:de:postal", "1996 also succeeds", None),
        ("regex:universal:email", "a@b.com", "a@b.com"),
    ],
)
def test_name_runs(spark, detector, value, kept):
    row = spark.createDataFrame([(detector, value)], "d string, v string")
    run = F.when(names.name_rule(F.col("d")), names.name_run(F.col("d"), F.col("v"))).otherwise(F.struct(F.lit(0).alias("skip"), F.col("v").alias("value")))
    got = row.select(run.alias("r")).first().r
    assert (got and got.value) == kept
    assert not kept or value[got.skip : got.skip + len(kept)] == kept


def test_person_words(spark):
    def of(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert of(names.person_tokens(F.lit(" Jan  KOWALSKI, "))) == ["jan", "kowalski"]
    assert of(names.is_person_variant(F.lit("J. Kowalski"), F.lit("Jan Kowalski"))) and not of(names.is_person_variant(F.lit("Jan Nowak"), F.lit("Jan Kowalski")))
    assert [of(names.variant_suffix(F.lit(v), F.lit("Jan Maria Kowalski"))) for v in ("Jan", "kowalski", "Jan Maria Adam Kowalski")] == ["FIRST", "LAST", "FULL"]
    assert of(names.match_case(F.lit("Smith"), F.lit("NOWAK"))) == "SMITH" and of(names.match_case(F.lit("Smith"), F.lit("Nowak"))) == "Smith"


def test_titles_are_no_persons(spark):
    rows = [(1, "PERSON", v, 0, len(v), 0.9, "m", 0) for v in ("Mr", "de", "Li", "J.", "X")] + [(1, "OTHER", "ab", 0, 2, 0.9, "m", 0)]
    assert sorted(r.value for r in spans.drop_short(spark.createDataFrame(rows, SPAN)).collect()) == ["J.", "Li"]


def test_propagation(spark):
    text = "Anna Kowalska came. KOWALSKA and kowalska-like, Kowalskas not. Ref 2026/2871x but 2026/2871 yes. Acme Tools LLC or Acme Tools."
    first = [("PERSON", "Anna Kowalska"), ("OTHER", "no 2026/2871"), ("COMPANY", "Acme Tools LLC")]
    rows = [(1, t, v, text.find(v), text.find(v) + len(v), 0.9, "m", 0) for t, v in first if v in text] + [(1, "OTHER", "no 2026/2871", 900, 912, 0.9, "m", 0)]
    out = propagate.propagate(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), spark.createDataFrame(rows, SPAN)).collect()
    got = sorted((r.value, r.start) for r in out)
    expect = [("Anna", 0), ("Kowalska", 5), ("KOWALSKA", 20), ("kowalska", 33), ("2026/2871", text.find("but 2026") + 4), ("Acme Tools", text.find("Acme")), ("Acme Tools", text.rfind("Acme"))]
    assert got == sorted(expect) and all(text[r.start : r.end] == r.value and r.doc_id == 1 for r in out)

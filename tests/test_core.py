"""Spans, sessions and packages against plain Python."""

import io
import math
import random
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.validators import VALIDATORS, validator
from palimpsest.operators import metrics, scan, session, spans
from palimpsest.plans import catalog
from palimpsest.plans.rules import RULES, SPACES, for_region, java_pattern
from palimpsest.sources import office
from palimpsest.streaming.sessions import number_batch

SCHEMA = "doc_id long, type string, value string, start int, end int, confidence double, detector string, ordinal int"


def test_scan_offsets_give_values(spark):
    text = "Mail  a@b.co,\n\nor +1 (132) 555-1352 / ünï@x.io\nip 10.0.0.1 10.0.0.300"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = scan.scan(docs, for_region("us")).collect()
    assert {r.value for r in rows} >= {"a@b.co", "10.0.0.1"}
    assert all(text[r.start : r.end] == r.value for r in rows)
    assert {r.doc_id for r in rows} == {1}


def test_word_edges_are_ascii(spark):
    hit = spark.range(1).select(F.regexp_extract(F.lit("é12345678901"), java_pattern(r"\b\d{11}\b"), 0).alias("x")).first().x
    assert hit == "12345678901"


def test_every_rule_compiles(spark):
    spark.range(1).select(*[F.regexp_extract_all(F.lit("x"), F.lit(java_pattern(r.pattern, r.flags)), F.lit(0)).alias(f"r{i}") for i, r in enumerate(RULES)]).collect()


def test_unknown_validator():
    assert len(VALIDATORS) == 31
    with pytest.raises(KeyError):
        validator("nope")


def test_overlaps_against_a_loop(spark):
    random.seed(3)
    rows = []
    for doc in range(40):
        for k in range(random.randint(0, 9)):
            a = random.randint(0, 30)
            rows.append((doc, "OTHER", "v", a, a + random.randint(1, 9), random.choice([0.3, 0.5, 0.9]), "d", k))
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {(r.doc_id, r.start, r.end, r.ordinal) for r in spans.resolve_overlaps(df).collect()}
    greedy = {(r.doc_id, r.start, r.end, r.ordinal) for r in spans.greedy_select(df).collect()}
    expect, best = set(), set()
    for doc in range(40):
        own = [r for r in rows if r[0] == doc]
        end = -1
        for r in sorted(own, key=lambda r: (r[3], -(r[4] - r[3]), -r[5], r[7])):
            if r[3] >= end:
                end = r[4]
                expect.add((doc, r[3], r[4], r[7]))
        chosen = []
        for r in sorted(own, key=lambda r: (-r[5], r[3], r[4], r[7])):
            if all(r[4] <= c[3] or r[3] >= c[4] for c in chosen):
                chosen.append(r)
        best |= {(doc, r[3], r[4], r[7]) for r in chosen}
    assert kept == expect
    assert greedy == best


def test_redact_and_restore(spark):
    docs = spark.createDataFrame([(1, "ask a@b.co or c@d.eu or a@b.co"), (2, "none"), (3, None)], "doc_id long, text string")
    found = scan.scan(docs, [RULES[0]])
    names = session.number_placeholders(found)
    hidden = session.redact(docs, found, names)
    assert {r.doc_id: r.text for r in hidden.collect()} == {1: "ask [EMAIL_1] or [EMAIL_2] or [EMAIL_1]", 2: "none", 3: None}
    assert {r.doc_id: r.text for r in session.restore(hidden, names).collect()}[1] == "ask a@b.co or c@d.eu or a@b.co"
    assert session.parse(session.serialise(names)).count() == 2
    with pytest.raises(ValueError):
        session.rename_label(names, "a@b.co", " ")
    assert "[MAIL]" in [r.replacement for r in session.rename_label(names, "a@b.co", "[MAIL]").collect()]


def test_coverage_of_a_union(spark):
    gold = spark.createDataFrame([(1, 0, 10), (1, 20, 30)], "doc_id long, start int, end int")
    pred = spark.createDataFrame([(1, 0, 4), (1, 2, 6), (1, 9, 12)], "doc_id long, start int, end int")
    assert {r.start: r.coverage for r in metrics.coverage(gold, pred).collect()} == {0: 0.7, 20: 0.0}


def test_stream_numbering_keeps_values():
    state = ([], [], [], [])
    first = number_batch("s", pd.DataFrame({"session_id": "s", "seq": [2, 1], "entity_type": "EMAIL", "original": ["b", "a"]}), *state)
    second = number_batch("s", pd.DataFrame({"session_id": "s", "seq": [3, 4], "entity_type": "EMAIL", "original": ["a", "c"]}), *state)
    assert list(first.replacement) == ["[EMAIL_1]", "[EMAIL_2]"]
    assert list(second.replacement) == ["[EMAIL_1]", "[EMAIL_3]"]


def test_docx_scrub_leaves_no_trace():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Ask An</w:t></w:r><w:r><w:t>na Nowak</w:t></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("docProps/thumbnail.jpeg", b"x")
    assert office.docx_text(raw.getvalue()) == "Ask Anna Nowak\nend"
    clean = office.scrub_package(raw.getvalue(), {"Anna Nowak": "[PERSON_1]", "Anna": "[PERSON_1]"})
    assert office.docx_text(clean) == "Ask [PERSON_1]\nend"
    assert "docProps/thumbnail.jpeg" not in zipfile.ZipFile(io.BytesIO(clean)).namelist()


def test_catalogue_names_match():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_region_de_scans_every_language(spark, tmp_path):
    rows = [(i, f"write to a{i}@example.com", lang) for i, lang in enumerate(("de", "en", "fr", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["detect_region_de"](spark, str(tmp_path)).where("type = 'EMAIL'").collect()
    assert sorted(r.doc_id for r in found) == [0, 1, 2, 3]


def test_fold_and_entropy_take_whole_texts(spark, tmp_path):
    rows = [(1, "x" * 100 + " Élan"), (2, "1st aab Ωmega aab"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {r.doc_id: r.plain for r in catalog.QUERIES["fold_diacritics"](spark, str(tmp_path)).collect()}
    assert plain == {1: "x" * 100 + " Elan", 2: rows[1][1], 3: None, 4: ""}
    bits = {(r.doc_id, r.word): r.bits for r in catalog.QUERIES["shannon_entropy"](spark, str(tmp_path)).collect()}
    assert bits == {(1, "x" * 100): 0.0, (1, "Élan"): 2.0, (2, "1st"): 1.584963, (2, "aab"): 0.918296, (2, "Ωmega"): 2.321928}


def test_scan_finds_what_each_rule_alone_finds_in_every_line(spark):
    """Cheap tests of lines, shared by rules, lose no match: spaces beyond ASCII, signs in other case, lines without a digit."""
    lines = [
        "Acme Trading GmbH", "Foo e. V. und", "in Höhe von zwei EURO", "pay the sum of two CENTS", "Rua Direita", "C/ Mayor", "calle Mayor 5", "AVENIDA Central",
        "Nr: AB12345", "id # XY 12345 6", "Hauptstraße 12", "HAUPTSTRASSE 12", "株式会社 山田", "三百円", "sk-ant-" + "a" * 24, "AKIA" + "A" * 16, "ghp_" + "a" * 36,
        "eyJ" + "a" * 8 + "." + "b" * 8 + "." + "c" * 8, "Steuer 86 095 742 719", "86 095 742 718", "nothing here", "", "Smith & Co. Ltd", "C.V. AG BV",
    ]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string")
    flat = docs.select("doc_id", F.explode(F.split(F.translate("text", SPACES, " " * len(SPACES)), "\n")).alias("line")).cache()
    rules = [(i, r) for i, r in enumerate(RULES) if not r.multiline]
    counts = flat.select(*[F.sum(F.size(F.regexp_extract_all("line", F.lit(java_pattern(r.pattern, r.flags, flat=True)), F.lit(0)))).alias(f"r{i}") for i, r in rules]).first()
    expect = {i: counts[f"r{i}"] for i, _ in rules if counts[f"r{i}"]}
    hits = scan._candidates(scan._held_lines(docs, [r for _, r in rules]), "line", rules).collect()
    text = "\n".join(lines)
    assert {i: sum(h.ordinal == i for h in hits) for i in {h.ordinal for h in hits}} == expect
    assert {"C/ Mayor", "nothing here"}.isdisjoint(h.value for h in hits) and len(expect) > 20
    assert "86 095 742 719" in {r.value for r in scan.scan(docs, for_region("de")).collect()}
    assert all(text[r.start : r.end] == r.value for r in scan.scan(docs).collect())


def test_checks_stay_small(spark):
    """An expression that names its last step twice doubles with each digit, and every task reads the whole plan."""
    sizes = {name: len(check(F.col("v"))._jc.toString()) for name, check in VALIDATORS.items()}
    assert max(sizes.values()) < 4000, sizes


def test_entropy_of_words_works_out_each_distinct_word_once():
    words = pa.array(["aab", "Ωmega", "", "𝄞𝄞b", "aab", "x"])
    bits = T._entropy_bits()(words).to_pylist()
    expect = [round(-sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)), 6) + 0.0 for w in words.to_pylist()]
    assert bits == expect
    assert math.copysign(1, bits[2]) == math.copysign(1, bits[5]) == 1


def test_restore_is_exact_where_spans_overlap(spark, tmp_path):
    text = "call +1 (683) 555-5442 55.95.145.182 or 55.95.145.182"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in catalog.QUERIES["restore_exact"](spark, str(tmp_path)).collect()} == {1: text, 2: None}

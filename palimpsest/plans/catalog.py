"""One query per operator over the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.validators import VALIDATORS
from ..operators import metrics, scan, session, spans, windows
from .rules import RULES, Rule, for_region, rules_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_BY_NAME = {r.name: r for r in reversed(RULES)}
WORD = r"[^\x20\x09-\x0D]+"
#: Rules whose spans overlap each other: what the span queries work on.
MIXED = (_BY_NAME["email"], _BY_NAME["phone_intl"], Rule("universal", "ipv4", "IP_ADDRESS", _BY_NAME["ipv4"].pattern, 0.9, need="[0-9]"), Rule("universal", "digits", "OTHER", r"[0-9]{2,}", 0.5, need="[0-9]"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_LINES = """l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start FROM l0)"""


def _rule_sql(r: Rule, order: int) -> str:
    p = r.pattern.replace("'", "''")
    return f"""SELECT doc_id, '{r.type}' AS type, ms[i] AS value, (line_start + list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::INT AS start,
    {r.confidence}::DOUBLE AS confidence, '{r.detector}' AS detector, {order} AS ordinal
    FROM (SELECT doc_id, line_start, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT *, regexp_extract_all(line, '{p}') AS ms, string_split_regex(line, '{p}') AS ps FROM lines) WHERE len(ms) > 0)"""


def spans_sql(*rules: Rule) -> str:
    """CTEs ending in ``spans``."""
    union = " UNION ALL ".join(_rule_sql(r, i) for i, r in enumerate(rules))
    return f'{_LINES}, spans AS (SELECT doc_id, type, value, start, (start + length(value))::INT AS "end", confidence, detector, ordinal FROM ({union}))'


def mixed(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(table(spark, d, "documents"), MIXED)


_MIXED = spans_sql(*MIXED)
_COLUMNS = 'doc_id, type, value, start, "end", confidence, detector, ordinal'


@query("segment_lines", f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, line, line_start::BIGINT AS line_start FROM lines WHERE length(line) > 0")
def segment_lines(spark, d):
    return scan.segment_lines(table(spark, d, "documents")).withColumn("line_start", F.col("line_start").cast("long"))


_LUHN = """list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(v), i, 1)::INT
    ELSE (CASE WHEN substr(reverse(v), i, 1)::INT > 4 THEN substr(reverse(v), i, 1)::INT * 2 - 9 ELSE substr(reverse(v), i, 1)::INT * 2 END) END)) % 10 = 0"""


def _detect(name: str, keep: str = "true"):
    rule = _BY_NAME[name]
    plain = Rule(**{**rule.__dict__})

    @query(f"detect_{name}", f"WITH {spans_sql(rule)}, t AS (SELECT *, regexp_replace(value, '[^0-9A-Za-z.]', '', 'g') AS v FROM spans) SELECT {_COLUMNS} FROM t WHERE {keep}")
    def run(spark, d):
        return scan.scan(table(spark, d, "documents"), [plain])


_detect("email")
_detect("phone_intl")
_detect("ipv4")
_detect("credit_card", _LUHN)
_detect("date_iso")
_detect("date_numeric")
_detect("mac_address")


@query("detect_all")
def detect_all(spark, d):
    return scan.scan(table(spark, d, "documents"), for_region("all"))


@query("detect_region_de")
def detect_region_de(spark, d):
    return scan.scan(table(spark, d, "documents"), for_region("de"))


@query("entities_by_type", f"WITH {_MIXED} SELECT lang, type, count(*) AS n, count(DISTINCT s.value) AS n_values FROM spans s JOIN documents USING (doc_id) GROUP BY lang, type")
def entities_by_type(spark, d):
    langs = table(spark, d, "documents").select("doc_id", "lang")
    return mixed(spark, d).join(langs, "doc_id").groupBy("lang", "type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query("pii_quality_join", f"WITH {_MIXED} SELECT quality, count(DISTINCT s.doc_id) AS docs, count(*) AS n FROM spans s JOIN labels USING (doc_id) GROUP BY quality")
def pii_quality_join(spark, d):
    return mixed(spark, d).join(table(spark, d, "labels"), "doc_id").groupBy("quality").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n"))


@query("threshold_filter", f"WITH {_MIXED} SELECT {_COLUMNS} FROM spans WHERE confidence >= 0.85")
def threshold_filter(spark, d):
    return spans.at_threshold(mixed(spark, d), 0.85)


@query("short_span_filter", f"WITH {_MIXED} SELECT {_COLUMNS} FROM spans WHERE length(trim(value)) >= 3")
def short_span_filter(spark, d):
    return spans.drop_short(mixed(spark, d))


_TRIMMED = Rule("universal", "quoted", "OTHER", r"[ (\"]+[0-9a-f]{3,}[ ,)\"]+", 0.6)


@query("trim_span_punctuation", f"""WITH {spans_sql(_TRIMMED)}, t AS (SELECT *, regexp_extract(value, '^[ ("]*', 0) AS lead, regexp_replace(regexp_replace(value, '^[ ("]+', ''), '[ ,)"]+$', '') AS core FROM spans)
SELECT doc_id, type, core AS value, (start + length(lead))::INT AS start, (start + length(lead) + length(core))::INT AS "end", confidence, detector, ordinal FROM t""")
def trim_span_punctuation(spark, d):
    docs = table(spark, d, "documents")
    lines = scan.segment_lines(docs)
    found = lines.select("doc_id", F.explode(scan.matches("line", _TRIMMED.pattern)).alias("m"), "line_start")
    start = (F.col("m.start") + F.col("line_start")).cast("int")
    rows = found.select("doc_id", F.lit("OTHER").alias("type"), F.col("m.value").alias("value"), start.alias("start"), (start + F.length("m.value")).cast("int").alias("end"), F.lit(0.6).alias("confidence"), F.lit(_TRIMMED.detector).alias("detector"), F.lit(0).alias("ordinal"))
    return spans.trim_punctuation(rows)


_RESOLVED = f"""{_MIXED}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" - start DESC, confidence DESC, ordinal) AS k FROM spans),
fold AS (SELECT *, true AS kept, "end" AS e FROM o WHERE k = 1 UNION ALL
  SELECT o.*, o.start >= f.e, CASE WHEN o.start >= f.e THEN o."end" ELSE f.e END FROM fold f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
resolved AS (SELECT {_COLUMNS} FROM fold WHERE kept)"""


@query("resolve_overlaps", f"WITH RECURSIVE {_RESOLVED} SELECT * FROM resolved")
def resolve_overlaps(spark, d):
    return spans.resolve_overlaps(mixed(spark, d))


@query("greedy_select")
def greedy_select(spark, d):
    return spans.greedy_select(mixed(spark, d))


_INSIDE = f"""{_MIXED}, wide AS (SELECT doc_id, detector, start, "end" FROM spans WHERE confidence <= 0.5),
c AS (SELECT w.doc_id, w.detector, w.start AS ws, w."end" AS we, s.start AS cs, s."end" AS ce FROM wide w LEFT JOIN (SELECT DISTINCT doc_id, start, "end", confidence FROM spans) s
   ON s.doc_id = w.doc_id AND s.confidence >= 0.8 AND s.start < w."end" AND s."end" > w.start)"""


@query("catch_all_gaps", f"""WITH {_INSIDE}, p AS (SELECT doc_id, detector, ws, we, unnest(range(ws, we)) AS pos FROM (SELECT DISTINCT doc_id, detector, ws, we FROM c)),
free AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id AND c.ws = p.ws AND c.we = p.we AND p.pos >= c.cs AND p.pos < c.ce)),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, detector, ws, we ORDER BY pos) AS g FROM free)
SELECT doc_id, detector, min(pos)::INT AS start, (max(pos) + 1)::INT AS "end" FROM isl GROUP BY doc_id, detector, ws, we, g""")
def catch_all_gaps(spark, d):
    return spans.catch_all_gaps(mixed(spark, d))


_PAIR = f"{_MIXED}, a AS (SELECT doc_id, start, \"end\", value FROM spans WHERE ordinal = 3), b AS (SELECT doc_id, start, \"end\" FROM spans WHERE ordinal < 3)"
_MEETS = 'a.doc_id = b.doc_id AND a.start < b."end" AND a."end" > b.start'


def _pair(spark, d, anti):
    rows = mixed(spark, d)
    return spans.overlapping(rows.where("ordinal = 3").select("doc_id", "start", "end", "value"), rows.where("ordinal < 3"), anti)


@query("interval_semi_join", f"WITH {_PAIR} SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_MEETS})")
def interval_semi_join(spark, d):
    return _pair(spark, d, False)


@query("interval_anti_join", f"WITH {_PAIR} SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_MEETS})")
def interval_anti_join(spark, d):
    return _pair(spark, d, True)


@query("valid_spans", f"WITH {_MIXED} SELECT {_COLUMNS} FROM spans")
def valid_spans(spark, d):
    return spans.valid_spans(mixed(spark, d), table(spark, d, "documents"))


_SURE = (MIXED[0], MIXED[1], MIXED[2])
_SURE_SQL = spans_sql(*_SURE)


def sure(spark, d):
    return scan.scan(table(spark, d, "documents"), _SURE)


_FIRST = f"""{_SURE_SQL}, vals AS (SELECT doc_id, value AS original, arg_min(type, struct_pack(s := start, e := "end", t := type)) AS entity_type, min(start) AS first, min("end") AS first_end, max(start) AS last FROM spans GROUP BY doc_id, value)"""
_MAP = f"""{_FIRST}, map AS (SELECT doc_id, entity_type, original, '[' || entity_type || '_' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY first, first_end, original) || ']' AS replacement,
   (row_number() OVER (PARTITION BY doc_id ORDER BY first, first_end, original))::INT AS seq FROM vals)"""


def reading_map(spark, d):
    return session.number_placeholders(sure(spark, d))


@query("placeholder_numbering", f"WITH {_MAP} SELECT * FROM map")
def placeholder_numbering(spark, d):
    return reading_map(spark, d)


@query("placeholder_numbering_reverse", f"""WITH {_FIRST} SELECT doc_id, entity_type, original, '[' || entity_type || '_' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY last DESC, original) || ']' AS replacement,
   (row_number() OVER (PARTITION BY doc_id ORDER BY last DESC, original))::INT AS seq FROM vals""")
def placeholder_numbering_reverse(spark, d):
    return session.number_placeholders(sure(spark, d), numbering="reverse")


def _redacted_sql(replacement: str, more: str = "") -> str:
    return f"""sp AS (SELECT s.doc_id, s.start, s."end", {replacement} AS r, lag(s."end", 1, 0) OVER (PARTITION BY s.doc_id ORDER BY s.start) AS before FROM spans s {more}),
red AS (SELECT d.doc_id, coalesce(string_agg(substr(d.text, sp.before + 1, sp.start - sp.before) || sp.r, '' ORDER BY sp.start), '') || substr(any_value(d.text), (coalesce(max(sp."end"), 0) + 1)) AS text
   FROM documents d LEFT JOIN sp ON sp.doc_id = d.doc_id GROUP BY d.doc_id)"""


@query("redact_blanked", f"WITH {_SURE_SQL}, {_redacted_sql(chr(39) + '________' + chr(39))} SELECT * FROM red")
def redact_blanked(spark, d):
    return session.redact(table(spark, d, "documents"), sure(spark, d))


_LABELLED = f"{_MAP}, {_redacted_sql('m.replacement', 'JOIN map m ON m.doc_id = s.doc_id AND m.original = s.value')}"


@query("redact_labeled", f"WITH {_LABELLED} SELECT * FROM red")
def redact_labeled(spark, d):
    return session.redact(table(spark, d, "documents"), sure(spark, d), reading_map(spark, d))


@query("restore_exact", "SELECT doc_id, text FROM documents")
def restore_exact(spark, d):
    found = spans.clipped(sure(spark, d))
    names = session.number_placeholders(found)
    return session.restore(session.redact(table(spark, d, "documents"), found, names), names)


@query("unresolved_tokens", f"""WITH {_LABELLED}, tok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\[[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_[0-9]+\\]'))) AS token FROM red)
SELECT doc_id, token FROM tok WHERE token NOT LIKE '%EMAIL%'""")
def unresolved_tokens(spark, d):
    return session.unresolved_tokens(redact_labeled(spark, d), reading_map(spark, d).where("entity_type = 'EMAIL'"))


@query("literal_counters", f"""WITH {_LABELLED}, tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_[0-9]+\\]')) AS t FROM red)
SELECT doc_id, regexp_extract(t, '^\\[(.*)_[0-9]+\\]$', 1) AS entity_type, max(regexp_extract(t, '_([0-9]+)\\]$', 1)::INT) AS reserved FROM tok GROUP BY ALL""")
def literal_counters(spark, d):
    return session.literal_counters(redact_labeled(spark, d))


_CANONICAL = "regexp_replace(lower(regexp_replace(regexp_replace({0}, '[*`~]', '', 'g'), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), '[^a-z0-9]+', '_', 'g')"


@query("canonical_placeholder", f"WITH {_MAP} SELECT doc_id, replacement, {_CANONICAL.format(chr(39) + '**' + chr(39) + ' || replacement')} AS canonical FROM map")
def canonical_placeholder(spark, d):
    return reading_map(spark, d).select("doc_id", "replacement", session.canonical_placeholder(F.concat(F.lit("**"), "replacement")).alias("canonical"))


@query("tolerant_index", f"WITH {_MAP} SELECT doc_id, {_CANONICAL.format('replacement')} AS canonical, min(replacement) AS replacement FROM map GROUP BY 1, 2 HAVING count(DISTINCT replacement) = 1")
def tolerant_index(spark, d):
    return session.tolerant_index(reading_map(spark, d))


@query("session_round_trip", f"WITH {_MAP} SELECT * FROM map")
def session_round_trip(spark, d):
    return session.parse(session.serialise(reading_map(spark, d), mode="surrogate", salt="s"))


@query("layer_zero_dictionary", f"WITH {_MAP} SELECT doc_id, arg_min(original, seq) AS value, arg_min(replacement, seq) AS replacement FROM map GROUP BY doc_id, lower(original)")
def layer_zero_dictionary(spark, d):
    return session.layer_zero(reading_map(spark, d))


@query("conversation_session", r"""WITH m AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS value, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{6,}'), 1) AS i FROM conversations),
f AS (SELECT conv_id, value, min(turn * 100000 + i) AS first FROM m GROUP BY ALL)
SELECT conv_id, value, '[OTHER_' || row_number() OVER (PARTITION BY conv_id ORDER BY first) || ']' AS replacement FROM f""")
def conversation_session(spark, d):
    hits = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(hits).alias("i", "value"))
    place = (F.col("turn") * 100000 + F.col("i") + 1).alias("start")
    named = session.number_placeholders(rows.select("conv_id", "value", F.lit("OTHER").alias("type"), place, place.alias("end")), key="conv_id")
    return named.select("conv_id", F.col("original").alias("value"), "replacement")


@query("shannon_entropy", """WITH w AS (SELECT doc_id, regexp_extract(text, '^[A-Za-z]+', 0) AS w FROM documents), c AS (SELECT doc_id, w, unnest(string_split(w, '')) AS c FROM w WHERE w <> ''),
n AS (SELECT doc_id, w, c, count(*) AS k FROM c GROUP BY ALL) SELECT doc_id, w AS word, round(-sum(k / length(w) * log2(k / length(w))), 6) + 0.0 AS bits FROM n GROUP BY doc_id, w""")
def entropy(spark, d):
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = table(spark, d, "documents").select("doc_id", F.explode(words).alias("word"))
    return rows.withColumn("bits", T.entropy_bits(F.col("word")))


@query("shannon_entropy_words", r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS word FROM documents), c AS (SELECT doc_id, word, unnest(range(1, length(word) + 1)) AS i FROM w),
n AS (SELECT doc_id, word, substr(word, i, 1) AS c, count(*) AS k FROM c GROUP BY ALL) SELECT doc_id, word, round(-sum(k / length(word) * log2(k / length(word))), 6) + 0.0 AS bits FROM n GROUP BY doc_id, word""")
def entropy_words(spark, d):
    return entropy(spark, d)


@query("excel_serial_date", """SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity * 1000 >= 1 THEN (CASE WHEN l_quantity * 1000 < 60 THEN DATE '1899-12-31' ELSE DATE '1899-12-30' END) + (floor(l_quantity * 1000))::INT END)::DATE::VARCHAR AS day FROM lineitem""")
def excel_serial_date(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.excel_date(F.col("l_quantity").cast("double") * 1000).cast("string").alias("day"))


_FIT = "CASE WHEN r >= 1 THEN 'fits' WHEN r >= 0.75 THEN 'shrink' WHEN r >= 0.6::DOUBLE THEN 'condense' ELSE 'overflow' END"


@query("fit_placeholder", f"SELECT l_orderkey, l_linenumber, {_FIT} AS stage FROM (SELECT *, l_quantity::DOUBLE / (5.0::DOUBLE * 6.0::DOUBLE) AS r FROM lineitem)")
def fit_placeholder(spark, d):
    fit = T.fit_placeholder(F.col("l_quantity").cast("double"), F.lit(6.0), F.lit(5.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fit["stage"].alias("stage"))


@query("fold_diacritics", f"SELECT doc_id, replace(replace(translate(substr(text, 1, 80), '{T.ACCENTED}', '{T.PLAIN}'), 'ß', 'ss'), 'œ', 'oe') AS plain FROM documents")
def fold_diacritics(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold_diacritics(F.col("text")).alias("plain"))


@query("fold_diacritics_text", f"SELECT doc_id, replace(replace(translate(text, '{T.ACCENTED}', '{T.PLAIN}'), 'ß', 'ss'), 'œ', 'oe') AS plain FROM documents")
def fold_diacritics_text(spark, d):
    return fold_diacritics(spark, d)


@query("office_files", "SELECT page_id, regexp_extract(url, '\\.([^./?#]+)$', 1) AS kind, url || '.redacted' AS plain_name FROM (SELECT page_id, 'f' || page_id || '.docx' AS url FROM pages) WHERE false UNION ALL SELECT page_id, 'word' AS kind, 'f' || page_id || '.redacted.docx' AS plain_name FROM pages")
def office_files(spark, d):
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit(".docx"))
    return table(spark, d, "pages").select("page_id", T.office_kind(name).alias("kind"), T.redacted_file_name(name).alias("plain_name"))


_PARTS = {"word/document.xml": "text", "word/media/image1.png": "unredactable", "word/_rels/document.xml.rels": "structural", "xl/sharedStrings.xml": "text", "xl/vbaProject.bin": "unredactable", "word/styles.xml": "structural", "misc/new.dat": "unknown"}


@query("package_part_classify", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _PARTS.items()) + ") t(path, kind)")
def package_part_classify(spark, d):
    return spark.createDataFrame([(k,) for k in _PARTS], "path string").select("path", T.classify_part(F.col("path")).alias("kind"))


@query("coverage_metric", f"""WITH {_MIXED}, g AS (SELECT DISTINCT doc_id, start, "end" FROM spans WHERE ordinal < 3), p AS (SELECT doc_id, start AS ps, "end" AS pe FROM spans WHERE ordinal = 3),
ch AS (SELECT doc_id, start, "end", unnest(range(start, "end")) AS pos FROM g)
SELECT doc_id, start, "end", round(avg(CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.doc_id = ch.doc_id AND pos >= ps AND pos < pe) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM ch GROUP BY ALL""")
def coverage_metric(spark, d):
    rows = mixed(spark, d)
    found = metrics.coverage(rows.where("ordinal < 3").select("doc_id", "start", "end").distinct(), rows.where("ordinal = 3"))
    return found.withColumn("coverage", F.round("coverage", 6))


@query("tally_by_category", "SELECT lang AS category, sum((n_chars > 1000)::INT)::BIGINT AS hits, count(*) AS total, round(avg((n_chars > 1000)::INT), 6) AS ratio FROM documents GROUP BY ROLLUP (lang)")
def tally_by_category(spark, d):
    return metrics.tally(table(spark, d, "documents"), "lang", F.col("n_chars") > 1000).withColumn("ratio", F.round("ratio", 6))


@query("latency_p95", "SELECT event_type, round(avg(value)) AS mean, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_p95(spark, d):
    return metrics.latency(table(spark, d, "events"), "value", "event_type")


@query("f1_score", "WITH r AS (SELECT lang, avg((n_chars > 500)::INT) AS p, avg((n_chars < 2000)::INT) AS q FROM documents GROUP BY lang) SELECT lang, round(2 * p * q / (p + q), 6) AS f1 FROM r")
def f1_score(spark, d):
    rows = table(spark, d, "documents").groupBy("lang").agg(F.avg((F.col("n_chars") > 500).cast("int")).alias("p"), F.avg((F.col("n_chars") < 2000).cast("int")).alias("q"))
    return rows.select("lang", F.round(metrics.f1(F.col("p"), F.col("q")), 6).alias("f1"))


@query("first_samples", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5")
def first_samples(spark, d):
    return metrics.first_samples(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("word_windows", r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[-_][\p{L}\p{N}]+)*|[^\s]')) AS n FROM documents),
x AS (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 150) / 110.0))::INT + 1)) AS k FROM w WHERE n > 0)
SELECT doc_id, k::INT AS window_no, (k * 110)::INT AS first_word, least(150, n - k * 110)::INT AS n_words FROM x""")
def word_windows(spark, d):
    return windows.word_windows(table(spark, d, "documents"))


_TOKENS = """tok AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, value, CASE event_id % 4 WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' WHEN 2 THEN 'O' ELSE 'I-LOC' END AS label FROM events)"""


@query("bio_merge", f"""WITH {_TOKENS}, x AS (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY place) AS b FROM tok),
y AS (SELECT *, sum(CASE WHEN label[1:2] = 'I-' AND b IS NOT NULL AND b <> 'O' AND b[3:] = label[3:] THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT doc_id, any_value(label[3:]) AS type, min(place)::INT AS start, (max(place) + 1)::INT AS "end", round(avg(value), 6) AS confidence FROM y WHERE label <> 'O' GROUP BY doc_id, g""")
def bio_merge(spark, d):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    label = F.element_at(F.array(*map(F.lit, ("B-PER", "I-PER", "O", "I-LOC"))), (F.col("event_id") % 4 + 1).cast("int"))
    tokens = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), place.alias("place"), label.alias("label"), place.alias("start"), (place + 1).alias("end"), F.col("value").alias("score"))
    return windows.bio_merge(tokens).withColumn("confidence", F.round("confidence", 6))


@query("softmax_argmax", """SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best, round(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS probability FROM embeddings""")
def softmax_argmax(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", x.alias("x"))
    return rows.select("vec_id", windows.argmax(F.col("x")).alias("best"), F.round(F.array_max(windows.softmax(F.col("x"))), 6).alias("probability"))


_VECTORS = {
    "luhn": ("4111 1111 1111 1111", "4111 1111 1111 1112"), "iban_mod97": ("GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"), "ip_octets": ("10.0.0.255", "10.0.0.256"), "nino": ("AB123456C", "BG123456C"),
    "nhs": ("9434765919", "9434765918"), "pesel": ("44051401359", "44051401358"), "nip": ("1234563218", "1234563219"), "regon": ("123456785", "123456786"), "dea": ("AB1234563", "AB1234564"), "npi": ("1234567893", "1234567894"),
    "aba": ("021000021", "021000022"), "nir": ("255081416802538", "255081416802539"), "dni": ("12345678Z", "12345678A"), "codice_fiscale": ("RSSMRA85T10A562S", "RSSMRA85T10A562T"), "partita_iva": ("12345670017", "12345670018"),
    "bsn": ("111222333", "111222334"), "nif": ("123456789", "123456788"), "ahv": ("756.9217.0769.85", "756.9217.0769.84"), "hetu": ("131052-308T", "131052-308U"), "pps": ("1234567FA", "1234567GA"), "svnr": ("1237010180", "1238010180"),
    "steuer_id": ("86095742719", "86095742718"), "belgian_nrn": ("85073003328", "85073003329"), "fodselsnummer": ("01010750160", "01010750161"), "pl_id_card": ("ABS123456", "ABS223456"), "uk_driving_licence": ("MORGA657054SM9IJ", "MORGA699054SM9IJ"),
    "personnummer": ("811218-9876", "811218-9877"), "samordningsnummer": ("701063-2391", "701003-2391"), "d_nummer": ("41010750160", "01010750160"), "secret_assignment": ("key = q9Zr7Tm2Xc5Vb8Nk4Lp", "key = aaaaaaaaaaaaaaaaaaaa"),
    "high_entropy_token": ("Zq9Rr7Tm2Xc5Vb8Nk4Lp1Wd6Hg3Fj0SaEyUiOo+/Bb", "a" * 44),
}


@query("validator_matrix", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', true, false)" for k in _VECTORS) + ") t(name, good, bad)")
def validator_matrix(spark, d):
    rows = [F.struct(F.lit(k).alias("name"), F.coalesce(VALIDATORS[k](F.lit(a)), F.lit(False)).alias("good"), F.coalesce(VALIDATORS[k](F.lit(b)), F.lit(False)).alias("bad")) for k, (a, b) in _VECTORS.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("region_filter", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {len(for_region(r))}::BIGINT)" for r in ("all", "us", "gb", "de", "fr", "pl")) + ") t(region, n)")
def region_filter(spark, d):
    asked = spark.createDataFrame([(r,) for r in ("all", "us", "gb", "de", "fr", "pl")], "region string")
    rules = rules_table(spark).select(F.col("region").alias("own"))
    fits = (F.col("region") == "all") | F.col("own").isin("universal") | (F.col("own") == F.col("region"))
    return asked.join(F.broadcast(rules), fits).groupBy("region").agg(F.count("*").alias("n"))


@query("cached_file_sets", "WITH need AS (SELECT n_regionkey AS s, n_nationkey AS f FROM nation), have AS (SELECT n_nationkey AS f FROM nation WHERE n_nationkey <> 3) SELECT s AS set_id, bool_and(h.f IS NOT NULL) AS cached FROM need LEFT JOIN have h USING (f) GROUP BY s")
def cached_file_sets(spark, d):
    nation = table(spark, d, "nation")
    have = nation.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("f"), F.lit(True).alias("present"))
    need = nation.select(F.col("n_regionkey").alias("set_id"), F.col("n_nationkey").alias("f"))
    return need.join(have, "f", "left").groupBy("set_id").agg(F.bool_and(F.coalesce("present", F.lit(False))).alias("cached"))

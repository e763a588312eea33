"""One thin query for each corpus operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, html_text, lines, mixing, near, pieces, rules, sharding, surrogates, topk
from .common import table

#: Bytes of text in a shard. Production shards are larger; this keeps several even in the small tables.
SHARD_BYTES = 1 << 20

#: Key of the surrogates. In production it comes from a secret store.
PII_KEY = "not a secret"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 5, 2, 1 in turn and share 150% of all words, each at most twice."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS h FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sums),
run AS (SELECT *, row_number() OVER o AS k, 2.0 * source_size AS cap,
    1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight
    FROM ranked WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST)),
lev AS (SELECT rest::DOUBLE AS rest, weight::DOUBLE AS weight FROM run WHERE NOT (cap::DOUBLE <= w * rest::DOUBLE / weight::DOUBLE) ORDER BY k LIMIT 1),
filled AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT rest FROM lev) * w / (SELECT weight FROM lev), cap::DOUBLE)) AS target FROM run),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM filled),
cum AS (SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id, s.size ROWS UNBOUNDED PRECEDING) AS c
    FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN 2 * c - size <= 2 * part THEN 1 ELSE 0 END))::BIGINT AS taken FROM cum
"""


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of at most SHARD_BYTES."""
    return sharding.shard(table(spark, sf_dir, "documents"), max_bytes=SHARD_BYTES)


OP3_SQL = f"""
WITH sized AS (SELECT doc_id, (coalesce(strlen(text), 0) + 16)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
deep AS (SELECT doc_id, n_bytes, h, d::INT AS depth, h >> (60 - d::INT) AS prefix FROM sized, range(0, 40) r(d)),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM deep GROUP BY ALL HAVING sum(n_bytes) <= {SHARD_BYTES} OR min(h) = max(h))
SELECT doc_id, n_bytes, depth, prefix, 0::BIGINT AS part, shard_bytes FROM deep JOIN sums USING (depth, prefix)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every hundredth."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH ready AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS n FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, q.n, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM ready q JOIN ready c ON q.n <> c.n WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER o)::INT AS rank, vec_id, score FROM pairs
WINDOW o AS (PARTITION BY n ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 10
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as piece ids, and whether decoding them gives the text back."""
    return pieces.encode(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the repeats of multi-line chunks."""
    return lines.line_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 12))::BIGINT AS h FROM l),
r AS (SELECT *, (h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % 281474976710597 AS r FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, CASE WHEN i = 0 OR coalesce(r < lag(r) OVER w AND r < lead(r) OVER w, false) THEN 1 ELSE 0 END AS b FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM b),
chunks AS (SELECT doc_id, c, min(i) AS s, string_agg(line, chr(10) ORDER BY i) AS bytes, count(*) AS n, count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS full_lines FROM c GROUP BY doc_id, c),
gone AS (SELECT doc_id, c FROM chunks WHERE n > 1 AND full_lines > 1 QUALIFY row_number() OVER (PARTITION BY bytes ORDER BY doc_id, s) > 1),
kept AS (SELECT c.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (g.c IS NULL) AS text, count(*) AS n_lines, count(g.c) AS n_removed
    FROM c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.c = g.c GROUP BY c.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents by 4-word shingles at 80%."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents; trusted are those labelled of good quality."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return rules.judge(table(spark, sf_dir, "documents"), trusted)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data and secrets."""
    return surrogates.anonymise(table(spark, sf_dir, "documents"), key=PII_KEY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_html_extraction": op2_html_extraction,
    "op3_sharding": op3_sharding,
    "op4_top_k": op4_top_k,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_pii": op10_pii,
}
SQL: dict[str, str] = {"op1_mixing": OP1_SQL, "op3_sharding": OP3_SQL, "op4_top_k": OP4_SQL, "op6_line_dedup": OP6_SQL}

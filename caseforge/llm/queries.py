"""The queries over the operators of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, chunk_dedup, decontaminate, html_extract, lexical_search, line_dedup, lm_scoring, mixing, near_dedup, quality_rules, token_align, topk_search, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.counted(_read(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.passages(_read(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_read(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no URL labels: the trees learn from the words of ``url_filter.SEED_WORDS`` in hosts."""
    return url_filter.judged(_read(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scored(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_read(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rendered(_read(spark, sf_dir, "conversations"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.measured(_read(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "embeddings")
    return topk_search.nearest(table, table.filter("vec_id % 50 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_lm_scoring, op2_line_dedup, op3_near_dedup, op4_substring_dedup, op5_html_extract, op6_url_filter, op7_quality_rules, op8_decontamination, op9_source_mixing, op10_chat_format, op11_token_align, op12_lexical_search, op13_topk_search)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


_LINES = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), judged AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""

_CONTAINED = r"""
WITH words AS (
  SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), items AS (
  SELECT item_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark
), doc_shingles AS (
  SELECT DISTINCT id, len(w) AS n, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), item_shingles AS (
  SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM items WHERE len(w) >= 5)
), sizes AS (
  SELECT id, count(*) AS size FROM item_shingles GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, any_value(d.n) AS doc_words, count(*) AS shared FROM doc_shingles d JOIN item_shingles i USING (s) GROUP BY d.id, i.id
)
SELECT doc_id, item_id, shared / size::DOUBLE AS containment, shared, size AS item_shingles, doc_words
FROM shared JOIN sizes ON sizes.id = item_id WHERE shared >= 0.8 * size
"""

_CHATS = r"""
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY place) AS said,
    string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY place) AS chat
  FROM placed GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM whole)
), same AS (
  SELECT said, min(conv_id) AS conv_id, count(*) AS n_same FROM whole GROUP BY said
)
SELECT w.conv_id, w.n_turns, s.n_same, w.chat FROM same s JOIN whole w USING (conv_id)
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.said = s.said)
"""


_TOP_PRODUCTS = r"""
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM fit
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scores
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""


_RANKED = r"""
WITH found AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), asked AS (
  SELECT i, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM found WHERE len(terms) > 0
), counts AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM found) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term, n_docs
), scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY i, item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW w AS (PARTITION BY i ORDER BY score DESC, doc_id, r) QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _LINES, "op8_decontamination": _CONTAINED, "op10_chat_format": _CHATS, "op12_lexical_search": _RANKED, "op13_topk_search": _TOP_PRODUCTS}

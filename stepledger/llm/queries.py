"""The queries of this package, by name, over the table ``documents`` and what belongs to it, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepledger.llm.decontamination import contaminations
from stepledger.llm.langid import learn_and_identify
from stepledger.llm.lines import dedup_lines
from stepledger.llm.merkle import document_manifest, lower_cased
from stepledger.llm.neighbours import nearest
from stepledger.llm.packing import pack_documents
from stepledger.llm.quality import learn_and_score
from stepledger.llm.ranking import rank_documents
from stepledger.llm.rules import quality_rules
from stepledger.llm.simhash import near_duplicates
from stepledger.llm.substrings import dedup_substrings
from stepledger.llm.suffixes import dedup_byte_strings
from stepledger.llm.tokens import count_tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query(
    r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NULL OR r.keeper = k.doc_id AS stays FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@_query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learn_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@_query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@_query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learn_and_identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@_query(
    r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS i, w FROM split WHERE len(w) >= 35),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM windows),
hits AS (SELECT doc_id, i FROM hashed WHERE h IN (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM hits, (SELECT unnest(generate_series(0, 34)) AS k)),
placed AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS word FROM split),
judged AS (SELECT p.doc_id, p.pos, p.word, g.pos IS NULL AS stays FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos),
kept AS (
  SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (stays) AS text FROM judged GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


@_query()
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("h1", "h2")


@_query()
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@_query(
    r"""
WITH sized AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, unnest(generate_series(0, n - 400)) AS i, h FROM sized WHERE n >= 400),
hashed AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM windows),
repeated AS (SELECT m FROM hashed GROUP BY m HAVING count(*) > 1),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hashed SEMI JOIN repeated USING (m)),
numbered AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY doc_id, span),
placed AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from FROM spans),
totals AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id),
parts AS (
  SELECT s.doc_id, p.kept_from AS f, substr(s.h, 2 * p.kept_from + 1, 2 * (p.a - p.kept_from)) AS piece FROM placed p JOIN sized s ON p.doc_id = s.doc_id
  UNION ALL SELECT s.doc_id, coalesce(t.last, 0), substr(s.h, 2 * coalesce(t.last, 0) + 1) FROM sized s LEFT JOIN totals t ON s.doc_id = t.doc_id),
kept AS (SELECT doc_id, sha256(unhex(string_agg(piece, '' ORDER BY f))) AS kept_sha256 FROM parts GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, k.kept_sha256
FROM sized s JOIN kept k ON s.doc_id = k.doc_id LEFT JOIN totals t ON s.doc_id = t.doc_id
"""
)
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_byte_strings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query(
    r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, totals WHERE term IN (SELECT term FROM wanted) GROUP BY term, docs),
gains AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // all_terms))) AS gain
  FROM held JOIN weights USING (term) JOIN sizes USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM wanted JOIN gains USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query(
    r"""
WITH RECURSIVE
numbered AS (
  SELECT *, coalesce('=' || lang, '') AS tree, CAST(doc_id AS VARCHAR) AS id,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
checked AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(0, 8 * length(id)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(id, i // 8 + 1, 1)) ELSE 0 END)),
      lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 3 = 0 AS changed
  FROM numbered),
fields AS (
  SELECT doc_id, tree, pos, n, id, source, lang, CAST(n_chars AS VARCHAR) AS size, text,
    CASE WHEN changed THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS found
  FROM checked),
leaves AS (
  SELECT doc_id, tree, pos, n, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS h,
    sha256(head || coalesce(octet_length(encode(found)) || ':' || found, '-')) AS claim
  FROM (SELECT *, coalesce(length(id) || ':' || id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(size) || ':' || size, '-') AS head FROM fields)),
nodes AS (
  SELECT tree, 0 AS level, pos, n, h FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, n, pos // 8),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT '/' AS tree, 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY tree, level, n, pos // 8),
every AS (SELECT * FROM nodes WHERE n > 1 UNION ALL SELECT * FROM tops WHERE n > 1),
runs AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 GROUP BY a.tree, a.level, a.pos),
steps AS (
  SELECT l.tree, l.pos, r.level AS step, r.before, r.after FROM leaves l JOIN runs r ON r.tree = l.tree AND r.pos = l.pos // CAST(pow(8, r.level) AS BIGINT)
  UNION ALL
  SELECT l.tree, l.pos, 1000 + r.level, r.before, r.after
  FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN runs r ON r.tree = '/' AND r.pos = s.pos // CAST(pow(8, r.level) AS BIGINT)),
path AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY step) AS k FROM steps),
folded AS (
  SELECT tree, pos, CAST(0 AS BIGINT) AS k, claim FROM leaves
  UNION ALL
  SELECT f.tree, f.pos, p.k, sha256(p.before || f.claim || p.after) FROM folded f JOIN path p ON p.tree = f.tree AND p.pos = f.pos AND p.k = f.k + 1),
proofs AS (SELECT tree, pos, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM path GROUP BY tree, pos),
ends AS (SELECT tree, pos, arg_max(claim, k) AS folded_root FROM folded GROUP BY tree, pos)
SELECT l.doc_id, l.h AS leaf, s.subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN tops r ON r.n = 1 JOIN ends e ON e.tree = l.tree AND e.pos = l.pos
LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
"""
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return document_manifest(docs, lower_cased(docs)).drop("witness")


@_query()
def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))
